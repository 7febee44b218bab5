"""Fill-in-middle, source mixing and the filter audit against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docsift.llm import fill_middle, filter_audit, source_mix
from docsift.llm.fill_middle import Rope

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = [" ", "  ", "\n", "\t\r", "\x1c", "\x85", "a", "Bc", "é", "日本", "😀", "<", "<P", "S>", "word", "#", "x" * 30]
CLASH = ["row", "n", "form", "output", "at", "tie", "fit", "cell", "copies", "part", "failed", "digest", "id", "filter", "applied", "step", "taken"]


def noise(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_rope_splits_like_a_list():
    for text in ["", " ", "a", *noise(3, 40, 900)]:
        units, rope = UNIT.findall(text), Rope.of(text)
        assert (rope.units, rope.chars, str(rope)) == (len(units), len(text), text)
        for rank in {0, 1, len(units) // 3, len(units) - 1, len(units)} | {63, 64, 65}:
            a, b = rope.split(rank)
            assert (str(a), str(b)) == ("".join(units[: max(0, rank)]), "".join(units[max(0, rank) :])) and a.units + b.units == len(units) and a.chars == len(str(a))
            a, b = (a + b).split(len(text) // 2, "chars")
            assert str(a) == text[: len(text) // 2] and str(b) == text[len(text) // 2 :] and a.units == len(UNIT.findall(str(a)))


def by_hand(text, doc_id):
    units = UNIT.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), output


def test_forms_equal_plain_python(spark):
    texts = [None, "", " \n", "one", "holds <P> here", "<M>", "<<S<P<M", "word " * 40_000, "x" * 300_000, " " * 100_000, *noise(5, 300, 200)]
    rows = [(i % 250, t) for i, t in enumerate(texts)] + [(None, "a null id with words"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = fill_middle.restore_documents(fill_middle.form_documents(docs)).collect()
    want = Counter((i, *by_hand(t or "", i), t or "") for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore_documents(fill_middle.form_documents(docs.limit(0))).count() == 0


def test_outputs_without_sentinels():
    assert fill_middle.restored("<P>a<S>b", "psm") is None and fill_middle.restored("abc", "spm") is None
    assert fill_middle.restored("x", "other") is None and fill_middle.restored(None, "plain") is None
    assert fill_middle.restored("<S><P><M>", "spm") == "" and fill_middle.restored("<P>a<<S>S<M>b", "psm") == "a<bS"


def test_nearest_sum_equals_every_choice():
    rng = random.Random(4)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 30), rng.randint(1, 4)))
        spare = [rng.randint(0, 3) for _ in sizes]
        left = rng.randint(0, 60)
        every = [sum(s * k for s, k in zip(sizes, c, strict=True)) for c in itertools.product(*[range(m + 1) for m in spare])]
        got = source_mix.nearest_sum(sizes, spare, left)
        assert all(0 <= k <= m for k, m in zip(got, spare, strict=True))
        near = min((abs(x - left), x) for x in every)
        assert sum(s * k for s, k in zip(sizes, got, strict=True)) == near[1]


def test_fitted_meets_the_budget():
    rng = random.Random(6)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 40_000), rng.randint(1, 60)))
        counts = [rng.randint(1, 10 ** rng.randint(0, 12)) for _ in sizes]
        total = sum(s * n for s, n in zip(sizes, counts, strict=True))
        budget = rng.randrange(total)
        got = source_mix.fitted(sizes, counts, budget)
        assert all(0 <= k <= n for k, n in zip(got, counts, strict=True))
        off = abs(sum(s * k for s, k in zip(sizes, got, strict=True)) - budget)
        assert off <= (0 if len(sizes) > 30 else sizes[-1] // 2)


def by_rounds(sizes):
    """Targets by resharing, exactly."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    got, open_, left = {}, set(order), Fraction(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 3 * sizes[s]}
        if not over:
            return got | {s: left * weight[s] / w for s in open_}
        for s in over:
            got[s] = Fraction(3 * sizes[s])
            left -= got[s]
        open_ -= over
    return got


@pytest.mark.parametrize("cell_rows", [1024, 3])
def test_mix(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(source_mix, "CELL_ROWS", cell_rows)
    rng = random.Random(cell_rows)
    sources = ["a", "b", "B", "é", "\U0001f600", "￮", None, "tiny", "none"]
    rows = []
    for i in range(3000):
        s = rng.choice(["a"] * 10 + sources[:7])
        rows.append((i, rng.choice(["word"] * 40 + ["two words", "w " * rng.randint(0, 300)]), s))
    rows += [(3001, "just a few", "tiny"), (3002, None, "none"), (3003, "", "none"), (None, "no id", "a"), (None, "no id", "a"), (5, "repeated id", None), (3004, "long " * 600, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in CLASH}).repartition(5)
    mix = source_mix.mix_rows(source_mix.sized(docs))
    got = [(r.row.doc_id, r.row.source, r.row.size, r.source_size, r.target, r.copies, r.taken) for r in mix.collect()]
    assert Counter((i, s, n) for i, s, n, *_ in got) == Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows)
    sizes = Counter()
    for _, s, n, *_ in got:
        sizes[s] += n
    goals, taken = by_rounds(dict(sizes)), Counter()
    for _, s, n, size, target, copies, words in got:
        assert size == sizes[s] and target == pytest.approx(float(goals[s])) and words == copies * n and 0 <= copies <= 3
        taken[s] += words
    for s, goal in goals.items():
        assert abs(taken[s] - float(goal)) <= 1 + (3 if s == "tiny" else 0), s
    again = source_mix.mix_rows(source_mix.sized(docs.repartition(3))).collect()
    assert Counter((r.row.doc_id, r.row.source, r.copies) for r in again) == Counter((i, s, c) for i, s, _, _, _, c, _ in got)
    assert source_mix.repeated(mix).count() == sum(c for *_, c, _ in got)
    assert source_mix.mix_rows(source_mix.sized(docs.limit(0))).count() == 0
    blank = source_mix.mix_rows(source_mix.sized(docs.where("source = 'none'"))).collect()
    assert [(r.source_size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def audit_by_hand(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang in rows]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    judged = []
    for i, t, lang in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged.append((lang, {k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    found, removed_by = {}, Counter()
    for lang in {j[0] for j in judged}:
        for order in itertools.permutations("ABCDE"):
            alive = [j for j in judged if j[0] == lang]
            for step, f in enumerate(order):
                out = [j for j in alive if f in j[1]]
                dead = [j for j in judged if j[0] == lang and f in j[1] and j[1] & set(order[:step])]
                alive = [j for j in alive if f not in j[1]]
                only = sum(j[0] == lang and j[1] == {f} for j in judged)
                found[lang, "".join(order), step + 1] = [len(alive), len(out), len(dead), only, sum(j[2] for j in out), sum(j[3] for j in out)]
                removed_by[lang, f] += len(out)
    return {(k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in ((k, tuple(v)) for k, v in found.items())}


def test_audit_equals_every_order(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d#", "e|e", "f", f"w{rng.random()}", "É"]) for _ in range(rng.choice([0, 3, 150, 199, 200, 260]))) for _ in range(25)]
    pool += [" ".join(f"w{i}" for i in range(220)), "AB" + "c" * 64, "A" + "c" * 32, "A" * 3 + "c" * 97, None, "", "\x1c \x85"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(300)]
    rows += [rows[0], rows[0], (5, pool[0], "en"), (5, pool[0], "de"), (4, pool[0], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in CLASH}).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("y") for c in CLASH})
    got = filter_audit.audit_filters(docs, known).collect()
    assert {((r.part, r.filter_order, r.step), r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == audit_by_hand(rows, labels)
    assert len(got) == 600 * 3
    assert filter_audit.audit_filters(docs.limit(0), known).count() == 0
    assert filter_audit.audit_filters(docs, known.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_lattice():
    assert len(filter_audit.edges()) == 80 and len(filter_audit.steps()) == 600
    assert sum(e["orders"] for e in filter_audit.edges()) == 600
