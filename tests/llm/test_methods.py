"""Operators against brute force, libraries and round trips."""

import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsift.llm import byte_bpe, components, embedding_dedup, jaccard_join, license_scan, line_dedup, packing, quality, ring_shards, telephony, url_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "'s", "'ll", "a", "B", "é", "ß", "日本", "١", "½", "!", "?!", "_", "😀", "\u0301", "\u200b", "\x00", "Σ", "İ", "word", "<|endoftext|>"]


def noise(seed, n, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_byte_bpe_equals_tiktoken():
    import tiktoken

    coder = byte_bpe.Coder(RANKS, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.rank, special_tokens={})
    texts = noise(1, 3000)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == want.encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()


def test_bpe_columns(spark):
    docs = spark.createDataFrame([*enumerate(noise(2, 50))], "doc_id long, text string")
    coded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_words_equal_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = noise(3, 3000) + ["hello <|endoftext|> there", "<|startoftext|>", "a<|ENDOFTEXT|>b"]
    for text, ids in zip(texts, packing.WordReader(path).ids(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_limits():
    rng = np.random.default_rng(1)
    pool = packing.Pool(64, 5, 40)
    want = {}
    for key in range(300):
        ids = rng.integers(0, 999, rng.integers(1, 150)).astype("<u4")
        want[key] = ids
        pool.add(key, ids, int(rng.integers(0, 30)))
    out = pool.pack(False) + pool.pack(True)
    taken, bins = collections.defaultdict(int), collections.defaultdict(list)
    for key, start, n, crc, total, sequence, offset, bears in sorted(out, key=lambda p: (p[0], p[1])):
        assert start == taken[key] and total == len(want[key])
        taken[key] += n
        bins[sequence].append((offset, n))
    assert all(taken[k] == len(v) for k, v in want.items())
    for parts in bins.values():
        assert len(parts) <= 5 and sum(n for _, n in parts) <= 64
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]


def test_full_sequences_without_prompts():
    rng = np.random.default_rng(2)
    pool = packing.Pool(4096, 512, 4096)
    total = 0
    for key in range(2000):
        n = int(rng.integers(1, 900))
        total += n
        pool.add(key, np.zeros(n, "<u4"))
    pool.pack(True)
    assert pool.sequence == -(-total // 4096)


def near_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            own = rng.choice(out)[:]
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 6, 7, 9, 20, 60, 200]))]
            if kind > 0.7:
                own += passage
        out.append(own)
    return [" ".join(o) for o in out]


@pytest.mark.parametrize(("n", "threshold", "block"), [(4, 0.85, 2000), (5, 0.8, 2000), (4, 0.85, 5)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, n, threshold, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    texts = near_texts(n, 400)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [set(jaccard_join.shingle_set(t, n).tolist()) for t in texts]
    forest = components.Forest()
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                forest.join(a, b)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs, n=n, threshold=threshold).collect()}
    assert got == {i: forest.root(i) for i in range(len(texts))}


def test_keep_one_judges_rows_of_one_id_by_their_text(spark):
    some, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, some, "x"), (5, some, "y"), (5, other, "z"), (5, "", "blank"), (7, other, "w"), (None, some, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.mark for r in got.collect()) == ["blank", "v", "x", "z"]


def test_keep_one_keeps_each_text_of_an_id(spark):
    """Two texts of one id that are unlike all others stay, and so does one of each of its groups."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(5, one, "x"), (5, two, "y"), (6, three, "z"), (9, two, "out"), (5, two + " more", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    assert sorted(r.mark for r in jaccard_join.keep_one(docs).collect()) == ["x", "y", "z"]


@pytest.mark.parametrize("held", [40, 400, 10**6])
def test_shared_elements_equal_brute_force(monkeypatch, held):
    monkeypatch.setattr(jaccard_join, "HELD_ELEMENTS", held)
    texts, rng = near_texts(4, 150), random.Random(4)
    rows = {jaccard_join._class(s): (rng.choice([-5, 7]), t, set(s.tolist())) for t in texts if len(s := jaccard_join.shingle_set(t, 2))}
    batches = [pa.RecordBatch.from_pylist([{"group": g, "class": c, "text": t} for c, (g, t, _) in part]) for part in (list(rows.items())[::2], list(rows.items())[1::2])]
    found = pa.Table.from_batches([out for b in batches for out in jaccard_join._held([b], 2, 3)]).to_pandas()
    got = collections.Counter()
    for _, frame in found.groupby("bucket"):
        got.update(dict(jaccard_join._shared(frame).itertuples(index=False)))
    times = {g: collections.Counter(x for own, _, s in rows.values() if own == g for x in s) for g in (-5, 7)}
    assert {c: got[c] for c in rows} == {c: sum(times[g][x] > 1 for x in s) for c, (g, _, s) in rows.items()}


def test_loners_leave_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) + " " + passage for k in range(8)]
    texts.append(texts[0] + " more")
    plain = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    chosen = [(jaccard_join._class(s), k, len(s), 1) for k, s in enumerate(jaccard_join.shingle_set(t, 5) for t in texts)]
    likely = jaccard_join._likely(plain, spark.createDataFrame(chosen, "class long, doc long, size long, group long"), 5, 0.8)
    assert sorted(r.doc for r in likely.collect()) == [0, 8]


def test_signatures_meet_for_similar_sets():
    rng = np.random.default_rng(5)
    for t in (0.8, 0.85):
        sizes = jaccard_join.Sizes(t)
        for _ in range(1500):
            size = int(rng.choice([1, 2, 5, 6, 7, 8, 13, 20, 40, 90, 300]))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.r_[b[rng.random(len(b)) > 0.03], rng.integers(0, 2**63, int(rng.integers(0, 2)), dtype=np.uint64)])
                both = len(np.intersect1d(a, c))
                if not len(c) or both < t * (len(a) + len(c) - both) - 1e-9:
                    break
                b = c
                if rng.random() < 0.1:
                    break
            common = np.sort(a[rng.random(len(a)) < rng.choice([0, 0.3, 0.9])])
            often = common, rng.integers(1, 9, len(common))
            assert len(np.intersect1d(jaccard_join.signatures(a, sizes, *often), jaccard_join.signatures(b, sizes, *often)))


def test_search_without_lists_of_the_main_component():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(120) > 0.03], rng.integers(0, 2**63, 2, dtype=np.uint64)]) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(30)]
    sets += [sets[-1][1:]]
    want = components.Forest()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.85 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                want.join(a, b)
    order = rng.permutation(len(sets))
    got = jaccard_join.search([sets[i] for i in order], 0.85)
    pairs = {frozenset((int(order[i]), int(order[j]))) for i in range(len(sets)) for j in range(i) if got.root(i) == got.root(j)}
    assert pairs == {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if want.root(i) == want.root(j)}


def same_components(sets, threshold):
    """The components by search() and by comparing all pairs."""
    want, got = components.Forest(), jaccard_join.search(sets, threshold)
    own = [set(s.tolist()) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            both = len(own[a] & own[b])
            if both >= threshold * (len(own[a]) + len(own[b]) - both) - 1e-9:
                want.join(a, b)
    return [[f.root(i) for i in range(len(sets))] for f in (got, want)]


def test_search_of_two_families_with_one_bridge():
    """Both families are taken out of the lists before the two sets of the bridge have probed."""
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    base, apart = new(100), new(24)
    other = np.r_[base[:76], apart]  # 76 of 124 elements: no link between the families' bodies
    families = [[np.unique(np.r_[body[rng.random(100) > 0.01], new(1)]) for _ in range(300)] for body in (base, other)]
    # each end is near one body (93 of 107, 92 of 108) and the other end (91 of 109)
    ends = [np.unique(np.r_[base[:93], apart[:7]]), np.unique(np.r_[base[:84], apart[:16]])]
    sets = [s for pair in zip(*families, strict=True) for s in pair]
    for bridge in (ends, []):
        got, want = same_components([*sets, *bridge], 0.8)
        assert got == want
        assert len(set(want)) == (1 if bridge else 2)


def test_search_of_long_chains():
    """Pieces of a chain grow apart and meet by single links."""
    rng = np.random.default_rng(6)
    for step in (2, 4):
        chains = [rng.integers(0, 2**63, 40 + 1500 * step, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(c[i : i + 40]) for c in chains for i in range(0, 1500 * step, step)]
        order = rng.permutation(len(sets))
        got = jaccard_join.search([sets[i] for i in order], 0.8)
        roots = {c: {got.root(k) for k, i in enumerate(order) if i // 1500 == c} for c in (0, 1)}
        assert len(roots[0]) == len(roots[1]) == 1 and roots[0] != roots[1]


def test_components_of_a_path(spark):
    path = list(range(60))
    random.Random(3).shuffle(path)
    edges = spark.createDataFrame([*zip(path, path[1:])] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    x = np.vstack([base, base[:1] + 0.12 * rng.standard_normal((90, 64)), base[:20] + 0.15 * rng.standard_normal((20, 64)), base[:2]]).astype(np.float32)
    label = np.r_[np.arange(40) % 3, np.zeros(90, int), np.arange(20) % 3, np.arange(2)]
    docs = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    forest = components.Forest()
    for a, b in np.argwhere(near).tolist():
        forest.join(a, b)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(docs, window=8).collect()}
    assert got == {i: (int(near[i].sum()), forest.root(i), forest.root(i) == i) for i in range(len(x))}
    assert near.sum() > 5000


@pytest.mark.parametrize("block", [2048, 100])
def test_pairs_in_a_crowd_below_the_threshold(spark, monkeypatch, block):
    """Vectors with one link each beside a thousand that are nearly linked; runs whole and in blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(12)
    x = rng.standard_normal(64) + 0.37 * rng.standard_normal((1500, 64))
    x = np.vstack([x, x[:80] + 0.32 * rng.standard_normal((80, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    forest = components.Forest()
    for a, b in np.argwhere(np.triu(near, 1)).tolist():
        forest.join(a, b)
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(docs).collect()}
    assert got == {i: (int(near[i].sum()) - 1, forest.root(i)) for i in range(len(x))}


def test_license_spans():
    find = license_scan.Notices(license_scan.NOTICES, license_scan.CHARS_PER_EDIT).find
    text = license_scan.folded("Foo, RELEASED under teh MIT-License. Licensed under the Apache Licence, Version 2.0; the mit licence alone")
    assert [(label, text[a:b], e) for label, a, b, e in find(text)] == [("mit", "released under teh mit license", 2), ("apache", "licensed under the apache licence version 2 0", 1)]
    # every text within the bound is found: a seed is left unedited
    rng = random.Random(8)
    for notice, label in license_scan.NOTICES:
        for _ in range(40):
            edited = list(notice)
            for _ in range(len(notice) // license_scan.CHARS_PER_EDIT):
                edited[rng.randrange(len(edited))] = rng.choice("xyz")
            assert label in {f[0] for f in find(f"some words {''.join(edited)} and more")}


def test_notices_next_to_each_other():
    """The better match stands behind, before and between others of one window."""
    find = license_scan.Notices(license_scan.NOTICES, license_scan.CHARS_PER_EDIT).find
    good, bad = "licensed under the apache license version 2 0", "licensed under the apach license version 2 0"
    for row in ([bad, good], [good, bad], [bad, good, bad], [bad, bad, good, good]):
        text = " ".join(row)
        assert [(text[a:b].strip(), e) for _, a, b, e in find(text)] == [(n, int(n == bad)) for n in row]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "The MIT-license mit license, Apache\nLICENSE x general public license permit license mit license"), (2, "mitlicense")], "doc_id long, text string")
    got = {r.doc_id: [(p.label, p.word) for p in r.phrases] for r in license_scan.scan_licenses(docs).collect()}
    assert got == {1: [("mit", 1), ("mit", 3), ("mit", 13), ("apache", 5), ("gpl", 8)], 2: []}


def test_ring_equals_row_by_row_walk(spark):
    docs = spark.range(997).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = ring_shards.shard_documents(docs, shards=7, points=16).collect()
    stops = ring_shards.ring(7, 16)
    places = [p for p, _ in stops]
    room = [143 if s < 997 % 7 else 142 for s in range(7)]
    import bisect
    import hashlib

    keyed = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i) for i in range(997))
    arcs = sorted((bisect.bisect_left(places, at) % len(places), at, i) for at, i in keyed)
    want = {}
    for arc, _, i in arcs:
        while not room[stops[arc % len(stops)][1]]:
            arc += 1
        room[stops[arc % len(stops)][1]] -= 1
        want[i] = stops[arc % len(stops)][1]
    assert {r.doc_id: r.shard for r in rows} == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_rows_move_to_another_ring(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old, new = ({r.doc_id: r.shard for r in ring_shards.shard_documents(docs, shards=n).collect()} for n in (10, 11))
    assert sum(old[i] != new[i] for i in old) < 0.3 * len(old)


def test_url_rules_match_like_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        spam = rng.random() < 0.3
        rows.append((i, f"http://{'cheap-pills' if spam else 'site' + str(i % 9)}.example.com/{'buy' if spam else 'en'}/{i}", spam))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = url_rules.mine_rules(pages.select("url", "bad"), support=0.05, confidence=0.9)
    assert mined and all(r["confidence"] >= 0.9 and r["support"] >= 0.05 for r in mined)
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, pages.select("url", "bad"), support=0.05, confidence=0.9).collect()}
    assert got == {i: "block" if any(set(r["tokens"]) <= t for r in mined) else "allow" for i, t in tokens.items()}
    assert "block" in got.values() and "allow" in got.values()


def test_url_rules_need_pages_and_lift(spark):
    """Labels that don't depend on the URL give no rule, few pages neither, and long paths don't multiply itemsets."""
    rng = random.Random(7)
    deep = "/".join(f"part{c}" for c in "abcdefghijklmno")
    rows = [(f"http://site{i % 50}.example.com/x/{i}", rng.random() < 0.3) for i in range(1500)] + [(f"http://few.example.org/y/{i}", True) for i in range(15)]
    plain = spark.createDataFrame(rows, "url string, bad boolean")
    assert url_rules.mine_rules(plain) == []
    nested = [(f"http://deep.example.info/{'/'.join(deep.split('/')[: 1 + i % 15])}", True) for i in range(600)]
    mined = url_rules.mine_rules(spark.createDataFrame(rows + nested, "url string, bad boolean"))
    assert mined and all(len(r["tokens"]) <= url_rules.MOST_ITEMS and r["lift"] >= url_rules.LEAST_LIFT for r in mined)
    assert mined[0]["cut_share"] > 0


def test_url_rules_see_all_items_of_a_page(spark):
    """A pair that is bad together, while each part tells less than nine other items of its page."""
    rng = random.Random(11)
    rows = []
    for i in range(1600):
        a, b, others = rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.5
        bad = a and b
        # nine items that lean to good pages, each with pages of its own
        lean = [k for k in range(9) if rng.random() < (0.9 if a and b else 0.04)]
        rows.append(("http:///" + "/".join(["aa"] * a + ["bb"] * b + [f"lean{chr(99 + k)}" for k in lean] + ["even"] * others), bad))
    # the nine stand in good pages too, so that no one of them is a rule
    rows += [("http:///" + "/".join(f"lean{chr(99 + k)}" for k in range(9) if k != i % 9), i % 3 == 0) for i in range(90)]
    rows += [(f"http:///{x}", False) for x in ("aa", "bb") for _ in range(1500)]
    pages = spark.createDataFrame(rows, "url string, bad boolean")
    mined = url_rules.mine_rules(pages, confidence=0.99)
    pair = [r for r in mined if r["tokens"] == ["path:aa", "path:bb"]]
    assert pair and pair[0]["confidence"] == 1.0 and pair[0]["cut_share"] > 0
    tokens = [({f"path:{x}" for x in u.split("/")[3:]}, y) for u, y in rows]
    for r in mined:
        held = [y for t, y in tokens if set(r["tokens"]) <= t]
        assert abs(r["confidence"] - sum(held) / len(held)) < 1e-9 and abs(r["support"] - sum(held) / len(rows)) < 1e-9


def test_adpcm_follows_a_sine():
    t = np.arange(121)
    wave = (8000 * np.sin(t / 9)).astype(int)
    value, index, nibbles = int(wave[0]), 40, []
    for x in wave[1:]:
        step, diff = int(telephony.STEPS[index]), int(x) - value
        code = 8 if diff < 0 else 0
        diff = abs(diff)
        change = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            if diff >= part:
                code |= bit
                diff -= part
                change += part
        value = max(-32768, min(32767, value - change if code & 8 else value + change))
        index = max(0, min(88, index + int(telephony.MOVES[code])))
        nibbles.append(code)
    body = bytes(a | b << 4 for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    block = int(wave[0]).to_bytes(2, "little", signed=True) + bytes([40, 0]) + body
    pcm = telephony.decode_adpcm(np.frombuffer(block * 3, np.uint8).reshape(3, 64))
    assert (pcm[0] == pcm[2]).all() and np.abs(pcm[1] - wave).max() < 1500 and pcm[1][-1] == value


def test_law_tables():
    mu, a = telephony.EXPAND[telephony.MU_LAW], telephony.EXPAND[telephony.A_LAW]
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


@pytest.mark.parametrize("codec", [telephony.MU_LAW, telephony.A_LAW, telephony.ADPCM, telephony.PCM])
def test_wav_round_trip(spark, codec):
    payload = bytes(range(256)) * 9
    assert telephony.read_wav(telephony.wav(payload, codec))[::3] == (codec, payload)
    stored = spark.createDataFrame([(1, telephony.wav(payload, codec)), (2, None)], "doc_id long, media binary")
    got = {r.doc_id: r.pcm for r in telephony.decode_media(stored).collect()}
    assert got[2] is None and len(got[1]) > 0


def test_ordinal_regression_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    graded = quality.grades(spark.read.parquet(f"{data}/labels.parquet")).where("grade is not null")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = quality.train(docs, graded.where(~held))
    assert (np.diff(model.cuts) > 0).all()
    scored = quality.score_documents(docs, model).select("row.doc_id", "expected_grade", "tail_probability").join(graded.where(held), "doc_id").toPandas()
    good = scored["grade"] == 2
    assert ((scored["tail_probability"] >= 0.5) == good).mean() > 0.9
    assert (scored["tail_probability"][good] >= 0.5).mean() > 0.95
    means = scored.groupby("grade")["expected_grade"].mean()
    assert means.is_monotonic_increasing


@pytest.mark.parametrize("form", [{}, {"block_bits": 1024}, {"block_bits": 1024, "broadcast_bytes": 0}])
def test_lines_equal_brute_force(spark, form):
    """One block, several, and several that the digests meet; all give the exact lines."""
    rng = random.Random(11)
    pool = [f"line number {i} of the common pool" for i in range(60)] + ["short", "", "  Padded Line Of Twenty Chars "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.4 else f"own line {rng.random()} of a document" for _ in range(rng.randint(0, 12))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for k in line_dedup.line_keys(t, 20):
            holders[k].add(i)
    gone = lambda k, i: k is not None and len(holders[k]) >= 3 and max(holders[k]) != i
    want = {i: "\n".join(p for p, k in zip(t.split("\n"), line_dedup.line_keys(t, 20), strict=True) if not gone(k, i)) for i, t in enumerate(texts)}
    got = {r.row.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs, **form).collect()}
    assert got == want and want != dict(enumerate(texts))


def test_suspects_are_few(spark):
    docs = spark.createDataFrame([(i, f"a line that document {i // 2 if i < 40 else i} holds alone") for i in range(2000)], "doc long, text string").repartition(4)
    assert 40 <= line_dedup.suspects(docs, 20, 1 << 12, 0).count() < 100


@pytest.mark.parametrize("gathered", [False, True])
def test_recall_of_single_pairs(spark, gathered):
    """Pairs just above the threshold, each vector with one link; spread evenly and gathered around one direction."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2500, 64)) + (2.0 if gathered else 0.0) * rng.standard_normal(64)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.vstack([base, 0.935 * base + np.sqrt(1 - 0.935**2) * side])
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(docs, window=64).collect()}
    assert sum(got.values()) >= 0.999 * near.sum() and all(got[i] <= n for i, n in enumerate(near.sum(axis=1).tolist()))


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 1.02], 1), (4, [-1e200, 1.0], 1), (5, [1.0, 0.0], 2), (5, [0.0, 1.0], 2), (6, [0.0, 1.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5), (5, 1, 5), (6, 1, 5)]


def test_media_equal_plain_python(spark):
    """Digests, loudness and stored PCM of each row against byte-wise Python."""
    import hashlib
    import struct
    import zlib

    texts = ["", None, "a", "b" * 575, "é" * 288, "\x00\x7f" * 900, "word " * 40_000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    stored = telephony.store_texts(docs)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in telephony.measure_media(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        own = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest()) and own in media[r.doc_id]
        wide = []
        for b in own:
            u = ~b & 255
            size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
            wide.append(-size if u & 128 else size)
        pcm = [x for a, b in zip(wide, [*wide[1:], wide[-1]], strict=True) for x in (a, (a + b) >> 1)]
        assert bytes(r.pcm) == struct.pack(f"<{len(pcm)}h", *pcm) and r.error is None
        told = dict(p.split("=") for p in r.feature.split(";"))
        assert told["mu_rms"] == f"{(sum(x * x for x in wide) / len(wide)) ** 0.5:.3f}" and int(told["mu_peak"]) == max(map(abs, wide))
        assert int(told["crossings"]) == sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:])) and int(told["pcm_crc32"]) == zlib.crc32(bytes(r.pcm))


def test_broken_media(spark):
    good = telephony.wav(b"\x55" * 100, telephony.MU_LAW)
    bad = telephony.wav(b"\x00" * 128, telephony.ADPCM)
    no_block = bad[:32] + b"\x00\x00" + bad[34:]
    rows = [(1, good), (2, None), (3, b"noise"), (4, good[:20]), (5, no_block), (1, good)]
    media = spark.createDataFrame(rows, "doc_id long, media binary").withColumns({"n_bytes": F.lit(7).cast("long"), "pcm": F.lit(1)})
    got = sorted((r.doc_id, r.pcm is not None, r.error is not None) for r in telephony.decode_media(media).collect())
    assert got == [(1, True, False), (1, True, False), (2, False, False), (3, False, True), (4, False, True), (5, False, True)]
    found = sorted((r.doc_id, r.payload_bytes, r.error is not None) for r in telephony.measure_media(media).collect())
    assert found == [(1, 100, False), (1, 100, False), (2, None, False), (3, None, True), (4, None, True), (5, None, True)]
    assert telephony.decode_media(media.limit(0)).count() == telephony.measure_media(media.limit(0)).count() == 0
