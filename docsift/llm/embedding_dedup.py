"""Near-duplicate embeddings by sorted projection passes.

Exact copies are one class. In each pass the classes of a label are ordered
lexicographically by concatenated random hyperplane hashes. Vectors that share
the first bits are a window of neighbours; a very long one, as in a crowd, is
cut into blocks that meet in pairs. A pass shuffles ids, codes and short
sketches (signs of further hyperplanes) alone: neighbours whose sketches differ
in too many bits aren't similar. What is left of a window, its crowd, then
fetches its vectors and is verified in double precision. Verified pairs are
united across passes; a crowd that earlier passes united already is left alone.
At last every member of a united group is compared with the whole group, in
blocks, to count its links. Pairs are never listed.

The bits and the number of passes follow the number of vectors, so that a pair
at the threshold shares no window with a probability of at most ``miss``: each
bit of it agrees with probability 1 - angle / pi, however the vectors lie. The
sketch loses a pair at the threshold with a probability below 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import dropped, small, stored
from docsift.llm.components import Forest, components

KEY_BITS = 62
SKETCH_BITS = 256
BLOCK = 2_048
ROWS = 512
#: Passes of the first round; the second skips what it united. Few vectors take one round, which gives the same links.
FIRST_PASSES, ROUND_ROWS = 2, 20_000


def window_bits(vectors: int, window: int) -> int:
    """The hash bits that the vectors of a window share."""
    return max(1, int(math.log2(max(2, vectors) / window)))


def passes_needed(vectors: int, threshold: float, window: int, miss: float) -> int:
    """Passes until a pair at the threshold was in one window, but for a share ``miss``."""
    once = (1 - math.acos(threshold) / math.pi) ** window_bits(vectors, window)
    return max(4, math.ceil(math.log(miss) / math.log1p(-min(once, 0.999))))


def sketch_cut(threshold: float) -> int:
    """The most sketch bits in which a pair may differ: six deviations above the mean at the threshold."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH_BITS * p + 6 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _matrices(column):
    """(rows, unit vectors) for each length of the lists in an Arrow column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.r_[0, np.cumsum(widths)[:-1]] if len(widths) else widths
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, _unit(flat[starts[rows][:, None] + np.arange(width)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is divided by its largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stacked(lists) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a pandas column, filled up with zeros to one length, and their own lengths."""
    widths = np.array([len(v) for v in lists], np.int64)
    x = np.zeros((len(widths), widths.max(initial=0)))
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        x[rows, :width] = _unit(np.stack([np.asarray(lists.iat[i], np.float64) for i in rows.tolist()]))
    return x, widths


def _keys(batches, turns: range, shift: int, seed: int):
    """A row for each vector and pass: the concatenated hash bits as one number, and the sketch."""
    for batch in batches:
        label, vec = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("label", "vec"))
        for rows, x in _matrices(batch.column("embedding")):
            width = x.shape[1]
            planes = lambda *name: np.random.default_rng([seed, width, *name]).standard_normal((width, SKETCH_BITS if len(name) < 1 else KEY_BITS))
            sketch = pa.array([s.tobytes() for s in np.packbits(x @ planes() > 0, axis=1)], pa.binary())
            for turn in turns:
                code = (x @ planes(turn + 1) > 0) @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                kinds = np.full(len(rows), turn, np.int32), label[rows], np.full(len(rows), width, np.int32), code >> shift, code, vec[rows]
                yield pa.RecordBatch.from_arrays([*map(pa.array, kinds), sketch], ["turn", "label", "width", "run", "code", "vec", "sketch"])


KEYED = "turn int, label long, width int, run long, code long, vec long, sketch binary"
RUN = ["turn", "label", "width", "run"]


def _unite(forest: Forest, vec: np.ndarray, near) -> None:
    """Unites linked vectors; ``near`` gives the links of some rows to all. Those of the largest component aren't compared with each other."""
    roots = np.array([forest.root(v) for v in vec.tolist()])
    names, sizes = np.unique(roots, return_counts=True)
    rest = np.flatnonzero(roots != names[sizes.argmax()])
    for lo in range(0, len(rest), ROWS):
        rows = rest[lo : lo + ROWS]
        names, place = np.unique([forest.root(v) for v in vec.tolist()], return_inverse=True)
        one, two = np.nonzero(near(rows) & (place[rows][:, None] != place))
        for pair in np.unique(place[rows][one] * len(names) + place[two]).tolist():
            forest.join(int(names[pair // len(names)]), int(names[pair % len(names)]))


def _crowds(vec: np.ndarray, sketch: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(crowd, vector) of the vectors that have a neighbour with a like sketch; a crowd is named by its smallest vector."""

    def near(rows):
        differ = np.bitwise_count(sketch[rows, None, 0] ^ sketch[None, :, 0])
        for k in range(1, sketch.shape[1]):
            differ = differ.astype(np.uint16) + np.bitwise_count(sketch[rows, None, k] ^ sketch[None, :, k])
        return differ <= most

    if len(vec) < 2:
        return []
    forest = Forest()
    _unite(forest, vec, near)
    found = forest.edges()
    return [(top, v) for v, top in found] + [(top, top) for top in {top for _, top in found}]


def _sorted_windows(batches, most: int):
    """Crowds of the windows of a sorted partition, which holds its windows whole."""

    def crowds(held):
        if len(held) < 2:
            return
        sketch = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint64).reshape(len(held), -1)
        found = _crowds(held.column("vec").to_numpy(), sketch, most)
        if found:
            top, vec = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), held.column("turn")[0].as_py(), np.int32)), top, vec], ["turn", "crowd", "vec"])

    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch])
        keys = np.stack([table.column(c).to_numpy() for c in RUN])
        starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1] if len(table) else np.zeros(1, int)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield from crowds(table.slice(lo, hi - lo))
        tail = table.slice(int(starts[-1]))
    if tail is not None:
        yield from crowds(tail)


def _long_window(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Crowds within two blocks of one window."""
    sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
    found = _crowds(frame["vec"].to_numpy(np.int64), sketch, most)
    return pd.DataFrame({"turn": pd.Series([frame["turn"].iat[0]] * len(found), dtype="int32"), "crowd": pd.Series([c for c, _ in found], dtype="int64"), "vec": pd.Series([v for _, v in found], dtype="int64")})


def _verified(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Forest edges of the linked vectors of the crowds of a bundle, or of two blocks of one."""
    forest = Forest()
    for _, part in frame.groupby(["turn", "crowd"], sort=True):
        part = part.drop_duplicates("vec")
        x, widths = _stacked(part["embedding"])
        label, vec = part["label"].to_numpy(), part["vec"].to_numpy(np.int64)
        _unite(forest, vec, lambda rows, x=x, w=widths, k=label: (x[rows] @ x.T >= threshold) & (w[rows][:, None] == w) & (k[rows][:, None] == k))
    found = forest.edges()
    return pd.DataFrame({"a": pd.Series([a for a, _ in found], dtype="int64"), "b": pd.Series([b for _, b in found], dtype="int64")})


def _count(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Copies linked to each class of block a, among those of block b, for all groups of a bundle."""
    out = []
    for _, part in frame.groupby("crowd", sort=True):
        asks, held = np.flatnonzero(part["side"] != 1), np.flatnonzero(part["side"] != 0)
        x, widths = _stacked(part["embedding"])
        label, vec, copies = part["label"].to_numpy(), part["vec"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
        for lo in range(0, len(asks), ROWS):
            rows = asks[lo : lo + ROWS]
            near = (x[rows] @ x[held].T >= threshold) & (widths[rows][:, None] == widths[held]) & (label[rows][:, None] == label[held]) & (vec[rows][:, None] != vec[held])
            out.append(pd.DataFrame({"vec": vec[rows], "n": near @ copies[held]}))
    return pd.concat(out) if out else pd.DataFrame({"vec": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})


def _in_blocks(members: DataFrame, groups: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """``members`` dealt to tasks: small groups share a bundle, each block of a large one meets every block of it.

    A member of a large group comes as side 0 with each block and as side 1
    for each block; members of small groups are of both sides (2).
    """
    sized = members.join(groups, key)
    own = F.xxhash64(*key)
    bundles = 1 + (groups.where(f"members <= {BLOCK}").agg(F.sum("members")).first()[0] or 0) // BLOCK
    none = F.lit(0).cast("long")
    alone = sized.where(f"members <= {BLOCK}").select(F.pmod(own, F.lit(bundles)).alias("bundle"), none.alias("block_a"), none.alias("block_b"), F.lit(2).alias("side"), *carried)
    blocks = F.ceil(F.col("members") / BLOCK)
    split = sized.where(f"members > {BLOCK}").withColumn("block", F.pmod(F.xxhash64("vec"), blocks)).withColumn("facing", F.explode(F.sequence(none, blocks - 1)))
    left = split.select(own.alias("bundle"), F.col("block").alias("block_a"), F.col("facing").alias("block_b"), F.lit(0).alias("side"), *carried)
    right = split.select(own.alias("bundle"), F.col("facing").alias("block_a"), F.col("block").alias("block_b"), F.lit(1).alias("side"), *carried)
    return alone.unionByName(left).unionByName(right)


def _links(classes: DataFrame, crowds: DataFrame, threshold: float) -> DataFrame:
    """Forest edges of the verified pairs of the crowds."""
    key = ["turn", "crowd"]
    groups = stored(crowds.groupBy(key).agg(F.count_distinct("vec").alias("members")), "crowd-sizes")
    work = _in_blocks(crowds.distinct().join(classes, "vec"), groups, key, [*key, "vec", "label", "embedding"])
    # of the two sides of a pair of blocks each holds both blocks, so one of them is enough
    work = work.where("side = 2 or block_a <= block_b").drop("side")
    return work.groupBy("bundle", "block_a", "block_b").applyInPandas(lambda f: _verified(f, threshold), "a long, b long")


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, window: int = 512, miss: float = 1e-5, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Rows of one label link if their cosine, in double precision, is at least
    ``threshold``. n_links counts other vec_ids, exact copies included;
    component_id is the smallest vec_id reachable over links; kept tells the
    rows of that vec_id. A vector that is null, empty or zero, or that holds a
    null, NaN or infinity, a row without a label and one without a vec_id link
    with nothing; vectors of different lengths do not link. A row without
    vec_id has a null component and is not kept. Repeated rows are one vector
    and give equal rows; of one vec_id with several vectors each row is judged
    by its own. Other columns are ignored. An empty table gives an empty
    result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    right = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    # a class is told by the hash of its vector, and its number by vector and label: one vec_id may come with several
    own = F.array_join(F.transform("embedding", lambda v: (v + F.lit(0).cast(kind)).cast("string")), ",")
    marked = plain.withColumn("vec", F.when(right, F.xxhash64("label", F.md5(own))))
    classes = stored(marked.where("vec is not null").groupBy("vec").agg(F.first("label").alias("label"), F.min("vec_id").alias("low"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding")), "vectors")

    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes, shift = passes_needed(largest, threshold, window, miss), KEY_BITS - window_bits(largest, window)
    most, links, united = sketch_cut(threshold), None, None
    for turns in (range(FIRST_PASSES), range(FIRST_PASSES, passes)) if largest > ROUND_ROWS else (range(passes),):
        keyed = classes.select("label", "vec", "embedding").mapInArrow(lambda b, t=turns: _keys(b, t, shift, seed), KEYED)
        keyed = stored(keyed, "passes")
        long = stored(keyed.groupBy(*RUN).count().where(f"count > {BLOCK}"), "long-windows")
        some = not long.isEmpty()
        short = keyed.join(F.broadcast(long), RUN, "left_anti") if some else keyed
        crowds = short.repartition(*RUN).sortWithinPartitions(*RUN[:3], "code", "vec").mapInArrow(lambda b: _sorted_windows(b, most), "turn int, crowd long, vec long")
        if some:
            blocks = F.ceil(F.col("count") / BLOCK)
            dealt = keyed.join(F.broadcast(long), RUN).withColumn("own", F.pmod(F.xxhash64("vec"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            dealt = dealt.select(*RUN, F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "vec", "sketch")
            crowds = crowds.unionByName(dealt.groupBy(*RUN, "block_a", "block_b").applyInPandas(lambda f: _long_window(f, most), "turn int, crowd long, vec long"))
        crowds = stored(crowds, "crowds")
        dropped(keyed)
        if links is not None:
            met = crowds.join(united, "vec", "left").groupBy("turn", "crowd").agg(F.min(F.coalesce("component", "vec")).alias("one"), F.max(F.coalesce("component", "vec")).alias("two"))
            crowds = crowds.join(met.where("one <> two").select("turn", "crowd"), ["turn", "crowd"], "left_semi")
        found = _links(classes, crowds, threshold)
        links = stored(found if links is None else found.unionByName(links), "vector-links")
        united = stored(components(links, "a", "b").select(F.col("node").alias("vec"), F.col("component")), "united")

    groups = united.groupBy(F.col("component").alias("crowd")).agg(F.count("*").alias("members"))
    members = classes.join(united.withColumnRenamed("component", "crowd"), "vec")
    work = _in_blocks(members, stored(groups, "group-sizes"), ["crowd"], ["crowd", "vec", "label", "copies", "embedding"])
    counted = work.groupBy("bundle", "block_a", "block_b").applyInPandas(lambda f: _count(f, threshold), "vec long, n long").groupBy("vec").agg(F.sum("n").alias("n"))
    ids = classes.drop("embedding", "label")
    lowest = united.join(ids, "vec").groupBy("component").agg(F.min("low").alias("component_id"))
    told = ids.join(united.join(lowest, "component"), "vec", "left").join(counted, "vec", "left")
    told = told.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    # copies share a class: while the classes are few they go to the rows, and beyond that Spark splits the frequent ones
    named = marked.select("vec_id", "vec").join(small(stored(told, "told")), "vec", "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id").isNotNull() & (F.coalesce("component_id", "vec_id") == F.col("vec_id"))).alias("kept"))
