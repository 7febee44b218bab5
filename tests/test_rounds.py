"""Document status, rereading, escalation, similarity by index and better sources."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docsift.operators import evaluate, resolve, vocabulary
from docsift.rules import RuleSet
from docsift.streaming import events


def test_run_ends_at_its_first_permanent_error(spark):
    rows = [(i, f"d{i}", None if i == 2 else "x", 1) for i in range(8)]
    errors = {1: "Timeout", 2: "invalid_api_key", 3: "PermissionDenied 403", 4: "permissiondenied", 6: "insufficient_quota"}
    docs = spark.createDataFrame(rows, "ord int, doc_id string, path string, spec_page int")
    outcomes = spark.createDataFrame([(f"d{i}", errors.get(i), 2 if i == 5 else 1) for i in range(8) if i != 7], "doc_id string, error string, page int")
    told = lambda *held: {r.ord: r.status for r in evaluate.document_status(docs, outcomes, spark.createDataFrame([(h,) for h in held], "doc_id string")).collect()}
    # a lost document's error doesn't count, as it was never read
    assert told("none") == {0: "SCORED", 1: "FAILED", 2: "NO_FILE", 3: "FAILED", 4: "STOPPED", 5: "STOPPED", 6: "STOPPED", 7: "STOPPED"}
    assert told("d3", "d4", "d0") == {0: "HOLDOUT", 1: "FAILED", 2: "NO_FILE", 3: "HOLDOUT", 4: "HOLDOUT", 5: "WRONG_PAGE", 6: "FAILED", 7: "STOPPED"}
    assert told("d6", "d4") == {0: "SCORED", 1: "FAILED", 2: "NO_FILE", 3: "FAILED", 5: "STOPPED", 7: "STOPPED"}
    assert evaluate.document_status(docs.limit(0), outcomes).count() == 0
    assert {r.reason for r in evaluate.document_status(docs, outcomes).collect()} == {None, "failed: Timeout", "no file", "failed: PermissionDenied 403", "stopped: a permanent error came before"}


def test_rows_to_score(spark):
    rows = spark.createDataFrame([(3, "c", "ann"), (1, "a", "draft by AI"), (2, "b", " "), (4, "d", "bob"), (5, "e", None)], "ord int, doc_id string, labeler string")
    ids = lambda **k: [r.doc_id for r in evaluate.choose_rows(rows, **k).orderBy("ord").collect()]
    assert ids() == ["a", "b", "c", "d", "e"] and ids(only=["c", "e"]) == ["c", "e"] and ids(limit=2) == ["a", "b"]
    assert ids(drafts="AI") == ["c", "d"] and ids(labelers=["bob", "draft by AI"]) == ["a", "d"] and ids(drafts="AI", limit=1) == ["c"]


RULES = RuleSet(RuleSet().rules | {"domain_rules": {"maker": {"map": [{"from": ["SEE"], "to": ""}]}}, "vocabulary": {}})


def test_reread_asks_for_what_is_open(spark):
    raw = spark.createDataFrame([("a", "maker", "see note", "Maker", 0.99, None), ("b", "maker", "SEE 2", "Maker", 0.99, None), ("c", "maker", "see 3", "Maker", 0.99, None), ("d", "maker", "ACME", "Maker", 0.5, "mine")], "doc_id string, field_key string, raw_value string, raw_label string, confidence double, note string")
    records = resolve.resolve(raw, raw.select("doc_id"), RULES)
    asked = []

    def reader(requests, k):
        asked.append((k, sorted((r.doc_id, r.raw_value) for r in requests.collect())))
        rows = {1: [("a", "EASTVALE"), ("b", "see again"), ("x", "never asked")], 2: [("b", "see this"), ("a", "late")], 3: []}[k]
        return spark.createDataFrame([(d, "maker", v, "Logo", 0.97) for d, v in rows], "doc_id string, field_key string, raw_value string, raw_label string, confidence double")

    got = {r.doc_id: r for r in resolve.reread(records, RULES, reader).where("field_key = 'maker'").collect()}
    assert asked == [(1, [("a", "see note"), ("b", "SEE 2"), ("c", "see 3")]), (2, [("b", "see again")])]
    told = {d: (r.value, r.failure, r.state, r.retry_count, r.retry_changed, r.retry_values) for d, r in got.items()}
    assert told["a"] == ("EASTVALE", "NONE", "auto", 1, True, ["see note", "EASTVALE"])
    assert told["b"] == ("", "EXTRACTION", "review", 2, True, ["see again", "see this"])
    assert told["c"] == ("", "EXTRACTION", "review", 1, False, []) and "can't be read again" in got["c"].note
    assert told["d"][:4] == ("ACME", "NONE", "review", 0) and got["d"].contract is None
    asked.clear()
    assert resolve.reread(records, RULES, reader, rounds=3).count() == records.count() and [k for k, _ in asked] == [1, 2, 3]
    clean = records.where("failure <> 'EXTRACTION'")
    asked.clear()
    assert resolve.reread(clean, RULES, reader).count() == clean.count() and not asked


def test_contract_and_escalation(spark):
    rows = [("a", "f", None, "review", " ", "normal"), ("a", "g", "N/A", "na", "why", "normal"), ("a", "h", "5", "na", "why", "normal"), ("a", "i", "5", "auto", None, "safety"), ("a", "j", "5", "auto", None, "normal")]
    records = spark.createDataFrame(rows, "doc_id string, field_key string, value string, state string, note string, safety string")
    got = {r.field_key: (r.contract, r.note) for r in resolve.contract(records).collect()}
    assert got == {"f": ("NO_NOTE", "broken contract NO_NOTE"), "g": (None, "why"), "h": ("NA_WITH_VALUE", "why | broken contract NA_WITH_VALUE"), "i": (None, "a person must look: safety or identity"), "j": (None, "")}
    counted = {r.counter: r.n for r in events.counters(events.escalation_events(resolve.escalations(records), "r")).collect()}
    assert counted == {"escalate": 3, "escalate_without_reason": 1}


def norm(s, ascii_only=False):
    return "".join(c for c in s.upper() if c.isalnum() and (c.isascii() or not ascii_only))


def words(rng, n, alphabet="abcdef12 /-"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    known = [*words(rng, 40), "DIAPHRAGM", "PISTON", "P I S T O N", "300#", "600#", "éa", "-"]
    values = [*words(rng, 300), "DIAFRAGM", "pistons", "900#", "éb", "", "..", None, None]

    def brute(v):
        scored = sorted(((SequenceMatcher(None, norm(v), norm(k)).ratio(), k) for k in dict.fromkeys(known)), reverse=True)
        return None if scored[0][0] < 0.7 or scored[0][0] - scored[1][0] < 1e-9 else scored[0][1]

    got = vocabulary.nearest(spark.createDataFrame([(v,) for v in values], "value string"), known).collect()
    assert len(got) == len(values) and {r.value: r.nearest for r in got} == {v: None if v is None else brute(v) for v in values}
    assert sum(r.nearest is not None for r in got) > 20


def test_suggest_equals_all_pairs(spark):
    rng = random.Random(3)
    names = [*words(rng, 30, "abcd"), "MODEL", "MODEL NO", "Rated Cv", "abcdabcd"]
    labels = [*words(rng, 300, "abcd "), "Model Number of the valve", "ode", "Rated Cv (US)", "Q", None, "", "abcdabcdabcd"]

    def brute(label):
        key, best, score = norm(label, True), None, 0.0
        for name in dict.fromkeys(names):
            n = norm(name, True)
            if len(key) < 3 or not n:
                continue
            r = SequenceMatcher(None, key, n).ratio()
            if min(len(n), len(key)) >= 4 and (n in key or key in n):
                r = max(r, 0.60 + 0.35 * (min(len(n), len(key)) / max(len(n), len(key))))
            if r > score:
                best, score = name, r
        return (best, score) if score >= 0.62 else (None, None)

    got = {r.label: (r.suggestion, r.ratio) for r in vocabulary.suggest(spark.createDataFrame([(x,) for x in labels], "label string"), names).collect()}
    want = {x: brute(x) if x is not None else (None, None) for x in labels}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] is None or abs(v[1] - want[k][1]) <= 0.00501 for k, v in got.items())


def test_looks_composite(spark):
    labels = ["Model No / Serial", "kg/cm2", "Model No", "Foo bar / Quux", "Model No / 12", " / Model No", None]
    got = {r.label: r.composite for r in vocabulary.looks_composite(spark.createDataFrame([(x,) for x in labels], "label string"), ["MODEL NO", "RATING"]).collect()}
    assert got == {"Model No / Serial": True, "kg/cm2": False, "Model No": False, "Foo bar / Quux": False, "Model No / 12": False, " / Model No": False, None: False}


def test_better_source(spark):
    rows = [("a", "maker", 1, "Logo", "X"), ("a", "act", 3, "Maker", "Y"), ("a", "pos", 2, "Manufacturer", "Z"), ("b", "maker", 1, "Logo", "X"), ("b", "act", 2, "Maker (footer)", "Y"), ("b", "pos", 3, "Maker", None), ("c", "maker", 1, "Maker", "X"), ("c", "act", 2, "Maker", "Y"), ("d", "maker", 1, "LOGO", None), ("d", "act", 2, "Maker", "Y")]
    records = spark.createDataFrame(rows, "doc_id string, field_key string, ord int, raw_label string, raw_value string").withColumn("value", F.col("raw_value"))
    assert [tuple(r) for r in vocabulary.better_sources(records, "maker").collect()] == [("a", "maker", "pos", "Z", "Manufacturer")]
