"""Set-similarity join on word shingles by T-occurrence search (DivideSkip).

1. Every document becomes its set of hashed n-word shingles; documents with one
   set are one class, told by the set's hash.
2. Pigeonhole, on the shingles that aren't common: a set of n elements and one with a Jaccard similarity of at least
   t to it differ in at most (1-t)/t*n elements. Dealt by hash into more parts
   than that, they share a whole part. Hashes of parts are shuffled, packed, and
   classes that share one are connected to candidate groups.
3. Only classes of candidate groups send their sets: small groups together, large
   ones cut into blocks by size and hash; each pair of blocks is one search. A
   large group is first rid of the sets that share too few of their elements
   with all others together. In a search
   the T-occurrence problem is solved by DivideSkip: a set's short inverted lists
   are merged by a heap that skips what can't reach T, and the long ones are
   probed by binary search for the sets that still can. Sets that are connected
   already needn't be compared again, so no pairs are listed.
4. The links found are united to components.

All counts are exact on 64-bit hashes of shingles and of sets.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import LOWER, UPPER, Cache, small, stored
from docsift.llm.components import Forest, components

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Odd multipliers for the words of a shingle and for mixing.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
BLOCK_SHINGLES = 1_500_000
BLOCK_SETS = 2_000
#: Sizes of a band of a large group differ by the threshold to this power at most.
BAND_STEPS = 4
BUCKET_ENTRIES = 1_000_000
FILED_ROWS = 4_000
#: Elements of large groups that are counted in one slice of a task, and the owner of those that are counted already.
HELD_ELEMENTS, NOBODY = 1_000_000, 0xFFFF
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("owner", "<u2")])
#: A shingle is common if so many of a batch's documents hold it, and half that share of all documents.
COMMON_SHARE, COMMON_LEAST = 0.0005, 4
#: The most common shingles that are told apart; a shingle beyond them is dealt like a rare one, which is right as well.
COMMON_MOST = 1_000_000
#: DivideSkip's weight of a binary search in a long list against a step of the heap.
DIVIDE = 0.0085
PROFILE = ["kind", "doc", "n_shingles", "class"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[3])
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int, known: Cache | None = None) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; all words as one if there are fewer; none without words.

    ``known`` holds hashes of words for the length of a task.
    """
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = (known or Cache()).fill({*words}, lambda new: map(xxhash.xxh3_64_intdigest, new))
    ids = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    width = min(n, len(ids))
    total = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mixed(total * np.uint64(MIX[0]) + ids[k : len(ids) - width + 1 + k])
    return np.unique(total)


class Sizes:
    """Size classes and the parts that sets of a class are dealt into."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.spread = max(1.6, 1 / threshold)

    def of(self, n: int) -> list[int]:
        """The classes under which a set of n elements is filed: its own and, if near the upper end, the next."""
        k = int(math.log(n) / math.log(self.spread) + 1e-9)
        return [k, k + 1] if n >= self.t * self.spread ** (k + 1) - 1 else [k]

    def differing(self, n: float) -> int:
        """The most elements in which a set of n elements differs from a similar one."""
        return int((1 - self.t) / self.t * n + 1e-6)

    def parts(self, k: int) -> int:
        return int(1.08 * self.differing(self.spread ** (k + 1))) + 2


def signatures(s: np.ndarray, sizes: Sizes, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Hashes of which any two similar sets share one.

    ``common`` is a sorted array of elements and ``times`` how often each
    occurs; any fixed choice is right. Only the other elements are dealt, or
    passages that many documents share would bring them all together. A set
    with more non-empty parts than elements that can differ has a part that a
    similar set holds unchanged. A set with fewer also gives the hashes of its
    prefix: two such sets, if similar, share one of the first
    n - ceil(t*n) + 1 elements in one order, here from rare to common.
    """
    weight = np.zeros(len(s), np.int64)
    if len(common):
        at = np.searchsorted(common, s)
        at[at == len(common)] = 0
        weight = np.where(common[at] == s, times[at], 0)
    rare = s[weight == 0]
    out, even = [], len(rare) > 0
    for k in sizes.of(len(s)) if len(rare) else ():
        part = _mixed(rare ^ np.uint64(MIX[2])) % np.uint64(sizes.parts(k))
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        even = even and len(starts) > sizes.differing(len(s))
        total = np.add.reduceat(_mixed(rare + np.uint64(MIX[0]))[order], starts)
        out.append(_mixed(total ^ (part[order][starts] * np.uint64(MIX[1]) + np.uint64(k))))
    if not even:
        prefix = s[np.argsort(weight, kind="stable")][: len(s) - math.ceil(sizes.t * len(s) - 1e-9) + 1]
        out.append(_mixed(prefix * np.uint64(MIX[3])))
    return np.concatenate(out)


class Lists:
    """Inverted lists of some sets: for each element the sorted numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray], members: list[int]):
        self.sizes = np.array([len(sets[i]) for i in members])
        self.members = np.array(members)
        flat = np.concatenate([sets[i] for i in members])
        order = np.argsort(flat, kind="stable")
        flat, self.owners = flat[order], np.repeat(np.arange(len(members), dtype=np.int32), self.sizes)[order]
        del order
        self.starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.terms, self.ends = flat[self.starts], np.r_[self.starts[1:], len(flat)]
        self.steps = array("i", self.owners.tobytes())

    def reach(self, probe: np.ndarray, t: float):
        """(sets, count, wanted, long lists) of those that may reach the overlap T with the probe; None if no set can.

        The L longest lists are left to be probed, L by DivideSkip's rule; a
        set in fewer than T - L of the others can't reach T.
        """
        at = np.searchsorted(self.terms, probe)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == probe]
        least = math.ceil(t * len(probe) - 1e-9)
        if len(at) < least:
            return None
        sizes = self.ends[at] - self.starts[at]
        at = at[np.argsort(sizes, kind="stable")]
        held = min(least - 1, int(least / (DIVIDE * math.log2(max(2, int(sizes.max()))) + 1)))
        short = len(at) - held
        found, count = self._merged(at[:short].tolist(), least - held)
        need = np.ceil(t / (1 + t) * (len(probe) + self.sizes[found]) - 1e-9).astype(int)
        fits = (self.sizes[found] >= least) & (self.sizes[found] * t <= len(probe) + 1e-9) & (count + held >= need)
        return found[fits], count[fits], need[fits], at[short:]

    def _merged(self, lists: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, count) of the sets in at least so many of the lists.

        A heap holds the head of each list. If the lowest set heads too few
        lists, the next ones are taken off as well until one more list would
        do, and all of them skip to the set that then is lowest.
        """
        steps, heads = self.steps, [(self.steps[self.starts[i]], int(self.starts[i]), int(self.ends[i])) for i in lists]
        heapify(heads)
        found, count = [], []
        while len(heads) >= least:
            low, taken = heads[0][0], []
            while heads and heads[0][0] == low:
                taken.append(heappop(heads))
            if len(taken) >= least:
                found.append(low)
                count.append(len(taken))
                for _, pos, end in taken:
                    if pos + 1 < end:
                        heappush(heads, (steps[pos + 1], pos + 1, end))
                continue
            while heads and len(taken) < least - 1:
                taken.append(heappop(heads))
            if not heads:
                break
            low = heads[0][0]
            for _, pos, end in taken:
                pos = bisect_left(steps, low, pos, end)
                if pos < end:
                    heappush(heads, (steps[pos], pos, end))
        return np.array(found, np.int64), np.array(count, np.int64)

    def reaching(self, found: np.ndarray, have: np.ndarray, want: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Which of the sets do reach their overlap: they are sought in the long lists by binary search, until that is sure."""
        have, open_ = have.copy(), np.arange(len(found))
        for left, i in zip(range(len(rest), 0, -1), rest.tolist(), strict=True):
            open_ = open_[(have[open_] < want[open_]) & (have[open_] + left >= want[open_])]
            if not len(open_):
                break
            own = self.owners[self.starts[i] : self.ends[i]]
            pos = np.minimum(own.searchsorted(found[open_].astype(np.int32)), len(own) - 1)
            have[open_] += own[pos] == found[open_]
        return have >= want


def search(sets: list[np.ndarray], threshold: float) -> Forest:
    """The components of a block's similar sets, as far as they follow from links within it.

    Each set probes the lists of the others; connected sets aren't compared.
    Once many of the listed sets are one component, they move to a shelf of
    their own: they still probe the listed sets, and the shelves of other
    components too. So of two sets that aren't connected one has probed the
    other, whenever either moved. A shelf gets lists when it is first probed.
    """
    forest, listed, shelves = Forest(), list(range(len(sets))), []
    moved = np.zeros(len(sets), bool)
    lists, look = Lists(sets, listed), 1

    def probe(i: int, lists: Lists) -> None:
        near = lists.reach(sets[i], threshold)
        if near is not None:
            found, have, want, rest = near
            home = forest.root(i)
            apart = np.array([forest.root(j) != home for j in lists.members[found].tolist()], bool)
            found = found[apart]
            for own in found[lists.reaching(found, have[apart], want[apart], rest)].tolist():
                forest.join(i, int(lists.members[own]))

    for i in range(len(sets)):
        if listed:
            probe(i, lists)
        for shelf in shelves if moved[i] else ():
            if forest.root(i) != forest.root(shelf[0][0]):
                if shelf[1] is None:
                    shelf[1] = Lists(sets, shelf[0])
                probe(i, shelf[1])
        if i + 1 == look:
            look = min(2 * look, look + 64)
            roots = [forest.root(j) for j in listed]
            main, n = Counter(roots).most_common(1)[0] if listed else (None, 0)
            if n > 16 and n > min(len(listed) // 2, max(200, len(listed) // 20)):
                shelves.append([[j for j, r in zip(listed, roots, strict=True) if r == main], None])
                moved[shelves[-1][0]] = True
                listed = [j for j, r in zip(listed, roots, strict=True) if r != main]
                lists = None  # before the new ones take room
                if listed:
                    lists = Lists(sets, listed)
            if not listed and len({forest.root(held[0]) for held, _ in shelves}) == 1:
                break
    return forest


def _class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _profiles(batches, n: int):
    """(kind 0, doc, n_shingles, class) of each document; (kind 1, documents of the batch, count, shingle) of shingles that many of them hold."""
    seen, known = set(), Cache()
    for batch in batches:
        counts, classes, new = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, n, known)
            counts.append(len(s))
            classes.append(_class(s) if len(s) else None)
            if len(s) and classes[-1] not in seen:
                seen.add(classes[-1])
                new.append(s)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(counts), pa.int32()), batch.column(0), pa.array(counts, pa.int64()), pa.array(classes, pa.int64())], PROFILE)
        if new:
            flat = np.sort(np.concatenate(new))
            starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            times = np.diff(np.r_[starts, len(flat)])
            often = times >= max(COMMON_LEAST, COMMON_SHARE * len(new))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(often.sum(), np.int32)), pa.array(np.full(often.sum(), len(new), np.int64)), pa.array(times[often].astype(np.int64)), pa.array(flat[starts][often].view(np.int64))], PROFILE)


def _filed(batches, n: int, threshold: float, buckets: int, common):
    """Signatures in packed rows, one for each bucket and slice of a batch: 40 bits of the hash and the place of the class."""
    sizes, seen, often, known = Sizes(threshold), set(), common.value, Cache()
    for whole in batches:
        for at in range(0, len(whole), FILED_ROWS):
            classes, found = [], []
            for doc, text in zip(*(c.to_pylist() for c in whole.slice(at, FILED_ROWS).columns), strict=True):
                s = shingle_set(text, n, known)
                if doc is None or not len(s) or (name := _class(s)) in seen:
                    continue
                seen.add(name)
                found.append(signatures(s, sizes, *often))
                classes.append(name)
            if not classes:
                continue
            owner = np.repeat(np.arange(len(classes), dtype=np.uint16), [len(x) for x in found])
            flat = np.concatenate(found)
            bucket = (flat >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            rows = np.empty(len(flat), ENTRY)
            rows["low"], rows["high"], rows["owner"] = flat[order].astype(np.uint32), (flat[order] >> np.uint64(32)).astype(np.uint8), owner[order]
            names = np.array(classes, np.int64)
            packed, table = [], []
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(flat)], strict=True):
                used, place = np.unique(rows["owner"][lo:hi], return_inverse=True)
                rows["owner"][lo:hi] = place
                packed.append(rows[lo:hi].tobytes())
                table.append(names[used].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts].astype(np.int64)), pa.array(table, pa.binary()), pa.array(packed, pa.binary())], ["bucket", "classes", "entries"])


def _candidates(frame: pd.DataFrame) -> pd.DataFrame:
    """A forest over the classes of one bucket that share a signature."""
    keys, names = [], []
    for table, packed in zip(frame["classes"], frame["entries"], strict=True):
        rows = np.frombuffer(packed, ENTRY)
        keys.append(rows["low"].astype(np.uint64) | rows["high"].astype(np.uint64) << np.uint64(32))
        names.append(np.frombuffer(table, np.int64)[rows["owner"]])
    keys, names = np.concatenate(keys), np.concatenate(names)
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    heads = np.repeat(np.minimum.reduceat(names, starts), np.diff(np.r_[starts, len(keys)]))
    apart = names != heads
    names, heads = names[apart], heads[apart]
    order = np.lexsort((heads, names))
    names, heads = names[order], heads[order]
    new = np.r_[True, (names[1:] != names[:-1]) | (heads[1:] != heads[:-1])] if len(names) else np.zeros(0, bool)
    forest = Forest()
    for a, b in zip(names[new].tolist(), heads[new].tolist(), strict=True):
        forest.join(a, b)
    found = forest.edges()
    return pd.DataFrame({"a": pd.Series([x for x, _ in found], dtype="int64"), "b": pd.Series([y for _, y in found], dtype="int64")})


def _held(batches, n: int, buckets: int):
    """Elements of the sets of large groups in packed rows, one for each bucket and slice of a batch.

    An element that several sets of a slice hold is counted for them there and
    sent once, without an owner, so that one that all hold is in no one's way.
    """
    known = Cache()

    def packed(names: list[int], sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        bucket = (flat >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((flat, bucket))
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])[order]
        flat, bucket, names = flat[order], bucket[order], np.array(names, np.int64)
        first = np.r_[True, flat[1:] != flat[:-1]]
        times = np.diff(np.r_[np.flatnonzero(first), len(flat)])
        several = np.repeat(times > 1, times)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        table, counts, entries = [], [], []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(flat)], strict=True):
            used, place = np.unique(owner[lo:hi], return_inverse=True)
            counts.append(np.bincount(place[several[lo:hi]], minlength=len(used)).astype(np.int32).tobytes())
            table.append(names[used].tobytes())
            place[several[lo:hi]] = NOBODY
            sent, one = flat[lo:hi][first[lo:hi]], np.empty(first[lo:hi].sum(), ENTRY)
            one["low"], one["high"], one["owner"] = sent.astype(np.uint32), (sent >> np.uint64(32)).astype(np.uint8), place[first[lo:hi]]
            entries.append(one.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), *[pa.array(x, pa.binary()) for x in (table, counts, entries)]], ["bucket", "classes", "counts", "entries"])

    for batch in batches:
        names, sets, size = [], [], 0
        for group, name, text in zip(*(batch.column(c).to_pylist() for c in ("group", "class", "text")), strict=True):
            s = shingle_set(text, n, known)
            if len(s) and _class(s) == name:
                names.append(name)
                sets.append(_mixed(s ^ np.uint64(group & 0xFFFFFFFFFFFFFFFF)))
                size += len(s)
            if size > HELD_ELEMENTS or len(sets) >= FILED_ROWS:
                yield packed(names, sets)
                names, sets, size = [], [], 0
        if sets:
            yield packed(names, sets)


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """How many elements of one bucket each class shares with any other of its group."""
    keys, owners, names, counts, at = [], [], [], [], 0
    for table, own, packed in zip(frame["classes"], frame["counts"], frame["entries"], strict=True):
        rows, table = np.frombuffer(packed, ENTRY), np.frombuffer(table, np.int64)
        keys.append(rows["low"].astype(np.uint64) | rows["high"].astype(np.uint64) << np.uint64(32))
        owners.append(np.where(rows["owner"] == NOBODY, -1, at + rows["owner"].astype(np.int64)))
        names.append(table)
        counts.append(np.frombuffer(own, np.int32))
        at += len(table)
    keys, owners, names, counts = map(np.concatenate, (keys, owners, names, counts))
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    times = np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)])
    met = owners[np.repeat(times > 1, times) & (owners >= 0)]
    return pd.DataFrame({"class": names, "shared": counts + np.bincount(met, minlength=at)}).groupby("class", as_index=False)["shared"].sum()


def _likely(plain: DataFrame, chosen: DataFrame, n: int, threshold: float) -> DataFrame:
    """``chosen`` without those classes of large groups that can't have a link.

    A link takes ``threshold`` of a set's elements at least, so a set goes if it
    shares fewer with all others of its group together. Each element of a large
    group is shuffled once for that; else sets that only share passages would
    be sent to each block of their group. Elements are told by hashes and a
    class that comes twice counts as two, so a count is never too low.
    """
    large = chosen.join(_weights(chosen).where("large").select("group"), "group")
    crowd = stored(large, "crowd")
    weight = crowd.agg(F.sum("size")).first()[0]
    if not weight:
        return chosen
    buckets = 1 + weight // BUCKET_ENTRIES
    texts = plain.join(small(crowd), "doc").select("group", "class", "text")
    held = texts.mapInArrow(lambda b: _held(b, n, buckets), "bucket long, classes binary, counts binary, entries binary")
    shared = held.groupBy("bucket").applyInPandas(_shared, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))
    alone = crowd.join(shared, "class", "left").where(F.coalesce("shared", F.lit(0)) < threshold * F.col("size") - 1e-6).select("class")
    return stored(chosen.join(stored(alone, "alone"), "class", "left_anti"), "chosen")


def _weights(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("group").agg(F.sum("size").alias("weight"), F.count("*").alias("n")).withColumn("large", F.expr(f"weight > {BLOCK_SHINGLES} or n > {BLOCK_SETS}"))


def _sets(batches, n: int):
    known = Cache()
    for batch in batches:
        sets = [shingle_set(t, n, known) for t in batch.column("text").to_pylist()]
        right = [i for i, (s, c) in enumerate(zip(sets, batch.column("class").to_pylist(), strict=True)) if len(s) and _class(s) == c]
        yield pa.RecordBatch.from_arrays(
            [batch.column("group").take(pa.array(right, pa.int64())), batch.column("class").take(pa.array(right, pa.int64())), pa.array([len(sets[i]) for i in right], pa.int64()), pa.array([sets[i].tobytes() for i in right], pa.binary())],
            ["group", "class", "size", "elements"],
        )


def _search_blocks(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links, as a forest of classes, within a bundle of groups or a pair of blocks of one group."""
    frame = frame.drop_duplicates("class").sort_values("class", kind="stable")
    names = frame["class"].tolist()
    found = search([np.frombuffer(x, np.uint64) for x in frame["elements"]], threshold).edges()
    return pd.DataFrame({"a": pd.Series([names[x] for x, _ in found], dtype="int64"), "b": pd.Series([names[y] for _, y in found], dtype="int64")})


def _grouped(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The rows of similar_groups() with the class of their set, and the class that names their component: ids may be shared by several."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    profiles = stored(plain.mapInArrow(lambda b: _profiles(b, n), "kind int, doc long, n_shingles long, class long"), "profiles")
    told = profiles.where("kind = 0").drop("kind")
    rows, total = told.agg(F.count("*"), F.sum("n_shingles")).first()
    total = total or 0
    # at most 2 / COMMON_SHARE times the mean size of a set, however many documents there are, and COMMON_MOST
    often = profiles.where("kind = 1").groupBy("class").agg(F.sum("n_shingles").alias("times")).where(F.col("times") >= COMMON_SHARE / 2 * rows)
    often = often.orderBy(F.desc("times"), "class").limit(COMMON_MOST).toPandas()
    held = often["class"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(held)
    common = spark.sparkContext.broadcast((held[order], often["times"].to_numpy(np.int64)[order]))
    buckets = 8 + int(total * 0.4 / BUCKET_ENTRIES)
    filed = plain.mapInArrow(lambda b: _filed(b, n, threshold, buckets, common), "bucket long, classes binary, entries binary")
    pairs = filed.groupBy("bucket").applyInPandas(_candidates, "a long, b long")
    groups = components(pairs, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("group"))

    classes = told.where("class is not null and doc is not null").groupBy("class").agg(F.min("doc").alias("doc"), F.first("n_shingles").alias("size"))
    chosen = _likely(plain, stored(classes.join(groups, "class"), "chosen"), n, threshold)
    whole = _weights(chosen)
    bundles = 1 + 2 * (chosen.agg(F.sum("size")).first()[0] or 0) // BLOCK_SHINGLES + chosen.count() // BLOCK_SETS
    # small groups share a bundle; large ones are cut into bands of sizes, of which only neighbours can be similar, and those by hash
    band = F.floor(F.log("size") / (-BAND_STEPS * math.log(threshold)) + 1e-9)
    known = chosen.join(whole.select("group", "large"), "group").withColumn("band", F.when(F.col("large"), band))
    bands = known.where("large").groupBy("group", "band").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS)).alias("blocks"))
    bundled = known.where("not large").select("class", "doc", "size", F.pmod(F.xxhash64("group"), F.lit(bundles)).alias("bundle"), F.lit(0).cast("long").alias("block"), "large")
    block = F.shiftleft("band", 32) + F.pmod(F.xxhash64("class"), "blocks")
    cut = known.where("large").join(bands, ["group", "band"]).select("class", "doc", "size", F.col("group").alias("bundle"), block.alias("block"), "large")
    places = stored(bundled.unionByName(cut), "places")
    spans = places.groupBy("large", "bundle", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    one, two = (spans.select("large", "bundle", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high")]) for k in "ab")
    meets = one.join(two, ["large", "bundle"]).where(f"block_a <= block_b and low_b * {threshold} <= high_a and low_a * {threshold} <= high_b")
    # a set goes to a pair of blocks only if the other block has sizes near its own
    facing = F.array_distinct(F.array(F.struct(F.col("block_a").alias("block"), F.col("low_b").alias("low"), F.col("high_b").alias("high")), F.struct(F.col("block_b").alias("block"), F.col("low_a").alias("low"), F.col("high_a").alias("high"))))
    sides = stored(meets.select("large", "bundle", "block_a", "block_b", F.inline(facing)), "sides")

    texts = plain.join(small(places), "doc").withColumn("group", F.struct("large", "bundle", "block")).select("group", "class", "text")
    kind = "group struct<large:boolean,bundle:bigint,block:bigint>, class long, size long, elements binary"
    sets = texts.mapInArrow(lambda b: _sets(b, n), kind).select("group.*", "class", "size", "elements")
    near = f"not large or (size * {threshold} <= high + 1e-6 and low * {threshold} <= size + 1e-6)"
    work = sets.join(small(sides), ["large", "bundle", "block"]).where(near).select("large", "bundle", "block_a", "block_b", "class", "elements")
    links = work.groupBy("large", "bundle", "block_a", "block_b").applyInPandas(lambda f: _search_blocks(f, threshold), "a long, b long")

    linked = stored(components(links, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("root")), "linked")
    # components carry class hashes so far: name each by its smallest document
    named = classes.join(linked, "class").select("class", "root", "doc")
    lowest = named.groupBy("root").agg(F.min("doc").alias("component"))
    named = named.join(lowest, "root").select("class", "component", "root")
    own = classes.join(named, "class", "left").select("class", F.coalesce("component", "doc").alias("component"), F.coalesce("root", "class").alias("root"))
    lone = F.col("doc").alias("doc_id"), "class", "n_shingles"
    some, none = told.where("class is not null and doc is not null"), told.where("class is null or doc is null")
    some = some.join(own, "class").select(*lone, F.col("component").alias("component_id"), "root")
    return some.unionByName(none.select(*lone, F.col("doc").alias("component_id"), F.lit(None).cast("long").alias("root")))


def similar_groups(docs: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over links.

    Two documents link when their shingle sets' Jaccard similarity is at least
    ``threshold``. Words are runs other than ASCII blanks, with A-Z folded. A
    null, empty or blank text has no shingles and no links. Rows with one
    doc_id each get a row; a null doc_id keeps a null component and links with
    nothing. Whole texts count, whatever their length. Other columns of
    ``docs`` are left alone. An empty table gives an empty result.
    """
    return _grouped(docs, n, threshold).drop("class", "root")


def keep_one(docs: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of similar documents: that with the smallest doc_id.

    Rows that share a doc_id are judged by their own texts: one of them stays
    for each group that their id names, the first by set and content, so that
    no text goes that is unlike all others. Rows without id or without words
    have no group and stay.
    """
    found = _grouped(docs, n, threshold)
    judged = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))).alias("other"))
    judged = stored(judged.where("rows > 1 and doc_id is not null or other"), "judged")
    named = F.pandas_udf(lambda texts: pd.Series([_class(s) if len(s := shingle_set(t, n)) else None for t in texts], dtype="Int64"), "long")
    kept = docs.alias("kept").join(small(judged).alias("gone"), F.col("kept.doc_id") == F.col("gone.doc_id"), "left_anti")
    mixed = judged.where("rows > 1").select(F.col("doc_id").alias("id"))
    if mixed.isEmpty():
        return kept
    own = stored(found.where("class is not null").join(mixed, F.col("doc_id") == F.col("id")).select("id", "class", "component_id", "root").distinct(), "repeated-ids")
    asked = docs.alias("d").join(small(stored(mixed, "ids")).alias("m"), F.col("d.doc_id") == F.col("m.id"), "left_semi")
    asked = asked.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), F.col("d.doc_id").alias("id"), named("d.text").alias("class"))
    chosen = asked.where("class is not null").join(own, ["id", "class"]).where("id = component_id")
    chosen = chosen.groupBy("id", "root").agg(F.min_by("row", F.struct("class", F.to_json(F.struct("row")))).alias("row"))
    return kept.unionByName(asked.where("class is null").select("row.*")).unionByName(chosen.select("row.*"))
