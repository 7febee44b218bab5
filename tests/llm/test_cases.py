"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import byte_bpe, embedding_dedup, jaccard_join, license_scan, line_dedup, packing, quality, ring_shards, telephony, url_rules

LONG = "word " * 40_000 + "\nreleased under the MIT license"
TEXTS = [(1, "a shared line of more than twenty\nown"), (2, None), (3, ""), (None, "a null id"), (4, LONG), (5, "   \n\t"), (1, "a shared line of more than twenty\nown"), (6, "é\u3000😀\x00\x85"), (None, None)]
CLASH = ["row", "doc", "class", "group", "h1", "drop", "at", "arc", "tie", "rank", "ids", "size", "shard", "vec", "kept_text", "bundle", "low"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return plain.withColumns({c: F.lit("x") for c in CLASH})


WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ONE_EACH = {
    "lines": line_dedup.dedup_lines,
    "licenses": license_scan.scan_licenses,
    "shards": ring_shards.shard_documents,
    "bpe": lambda d: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "similar": lambda d: jaccard_join.similar_groups(d, n=4, threshold=0.85),
    "media": lambda d: telephony.measure_media(telephony.store_texts(d)),
    "quality": lambda d: quality.score_documents(d, quality.fit([], None)),
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_one_row_each(spark, docs, name):
    assert ONE_EACH[name](docs).count() == len(TEXTS)


@pytest.mark.parametrize("name", ONE_EACH)
def test_empty_table(spark, docs, name):
    assert ONE_EACH[name](docs.limit(0)).count() == 0


def test_packing_takes_every_row(spark, docs):
    got = packing.pack_documents(docs, WORDS).groupBy().agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("t")).first()
    assert got.n == got.t
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_null_texts(spark, docs):
    sets = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs, n=4, threshold=0.85).collect()}
    assert (2, 0, 2) in sets and (3, 0, 3) in sets and (5, 0, 5) in sets and (None, 1, None) in sets and (None, 0, None) in sets
    lines = {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[2] == (1, 0, "") and lines[3] == (1, 0, "")
    media = {r.doc_id: (r.n_bytes, r.payload_bytes) for r in telephony.measure_media(telephony.store_texts(docs)).collect()}
    assert media[2] == (0, 576) and media[6][1] == 576


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.01], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0), (9, [float("nan"), 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, kind).withColumns({c: F.lit(1) for c in ("vec", "code", "copies", "block")})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors).collect())
    linked = {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)}
    assert set(got) == linked | {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)} | {(0, 0, None, False)} and len(got) == len(rows)
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "nothing"), (4, "http://A.Example.NET/en/x?q#f"), (5, "x://net"), (None, "http://example.com/de/1"), (4, "http://a.org/fr/#x")], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("tokens", F.lit("y"))
    labels = spark.createDataFrame([], "url string, bad boolean")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, labels).collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (5, "net", "", None, "allow"), (None, "example.com", "/de/1", "example.com/de/", "block"), (4, "a.org", "/fr/", "org/fr/", "allow"),
    ]
    assert url_rules.judge_urls(pages.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, tmp_path, name):
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    full = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = stage(spark, full, str(tmp_path))
    got.count()
    if name != "packing":
        assert got.columns == full.columns
    assert stage(spark, full.limit(0), str(tmp_path)).count() == 0
