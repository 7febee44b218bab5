"""The pipeline's stages against plain Python on the smallest documents."""

from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import components, jaccard_join, line_dedup, packing, quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, quality.grades(spark.read.parquet(f"{DATA}/labels.parquet")))
    rows = {r.doc_id: r.text for r in docs.collect()}
    tails = model.tails(list(rows.values()))[:, -1]
    kept = {i: t for (i, t), p in zip(rows.items(), tails, strict=True) if p >= 0.5}
    assert 0 < len(kept) <= len(rows)

    holders = defaultdict(set)
    keys = {i: line_dedup.line_keys(t, line_dedup.MIN_CHARS) for i, t in kept.items()}
    for i, own in keys.items():
        for k in own:
            holders[k].add(i)
    gone = lambda k, i: k is not None and len(holders[k]) >= line_dedup.MIN_DOCS and max(holders[k]) != i
    cut = {i: "\n".join(p for p, k in zip((t or "").split("\n"), keys[i], strict=True) if not gone(k, i)) for i, t in kept.items()}

    sets = {i: set(jaccard_join.shingle_set(t, 5).tolist()) for i, t in cut.items()}
    forest = components.Forest()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                forest.join(a, b)
    left = {i: t for i, t in cut.items() if forest.root(i) == i}

    pieces = corpus_pipeline.run(spark, DATA).orderBy("doc_id", "start").collect()
    read = packing.WordReader(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = {i: len(ids) + 1 for i, ids in zip(left, read.ids(list(left.values())), strict=True)}
    got = defaultdict(int)
    for p in pieces:
        assert p.start == got[p.doc_id] and p.doc_tokens == want[p.doc_id]
        got[p.doc_id] += p.length
    assert got == want
    assert sum(want.values()) > 4096 and np.isfinite(tails).all()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"row": F.lit(1), "class": F.lit("x")})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
    changed = docs.where(F.length("text") != F.col("n_chars")).count()
    assert changed == 0
