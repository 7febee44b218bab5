"""Queries that SQL can't express against plain Python on the smallest tables, and the classifier's likelihood."""

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from docsift.llm import quality, queries

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@needs_data
def test_license_scan_counts_and_places(spark):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, DATA).collect()}
    docs = texts(spark)
    assert set(got) == set(docs)
    for i, text in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        starts, r = [k for k, _ in places], got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(r.labels.split(",")) >= {x for _, x in places} and r.labels == ",".join(sorted(set(r.labels.split(","))))


@needs_data
def test_packing_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*words.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts(spark).items()}
    at, pieces = defaultdict(list), defaultdict(list)
    for r in queries.op3_packing(spark, DATA).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0 and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        at[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for runs, total in [*((sorted(v), None) for v in at.values()), *((sorted(v), len(ids[i])) for i, v in pieces.items())]:
        ends = np.cumsum([n for _, n in runs])
        assert [s for s, _ in runs] == [0, *ends[:-1].tolist()] and (ends[-1] <= 4096 if total is None else ends[-1] == total)
    assert set(pieces) == set(ids)


@needs_data
def test_url_hosts_paths_and_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    seen = set()
    for r in queries.op5_url_rules(spark, DATA).collect():
        rest = (pages[r.page_id] or "").partition("://")[2] if "://" in (pages[r.page_id] or "") else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h) + len(p), h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
        seen.add(r.rule)
    assert len(seen) > 1


def test_fit_ends_where_the_likelihood_is_flat():
    """Directional differences of the mean log likelihood at the end of a long fit, on grades that words don't settle."""
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 40, 12)).astype(np.int32), None) for _ in range(400)]
    rows = [(s, rng.uniform(0.2, 1.0, len(s)).astype(np.float32)) for s, _ in rows]
    lean = rng.standard_normal(40)
    grades = np.digitize([lean[s] @ v + 2 * rng.standard_normal() for s, v in rows], [-1.0, 1.0])
    model = quality.fit(rows, grades, bits=8, rounds=4000, rate=0.01, penalty=0.0)

    def loss(weights, cuts):
        score = np.array([weights[s] @ v for s, v in rows])
        tail = np.c_[np.ones(len(rows)), 1 / (1 + np.exp(cuts - score[:, None])), np.zeros(len(rows))]
        n = np.arange(len(rows))
        return -np.log(tail[n, grades] - tail[n, grades + 1]).mean()

    free = model.weights != 0
    assert free.sum() >= 20 and model.cuts[0] < model.cuts[1] and loss(model.weights, model.cuts) < loss(0 * model.weights, np.array([-1.0, 1.0])) - 0.02
    for _ in range(30):
        step, cut = 1e-4 * rng.standard_normal(len(free)) * free, 1e-4 * rng.standard_normal(2)
        slope = (loss(model.weights + step, model.cuts + cut) - loss(model.weights - step, model.cuts - cut)) / 2e-4
        assert abs(slope) < 2e-3
