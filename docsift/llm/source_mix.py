"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is over
its size gives all its documents as many whole times as fit; what is left of
the budget is spread over the lengths in proportion to their counts, and the
last words are fitted by a bounded-knapsack dynamic programme over the lengths
that still have documents. Seeded ranks then choose the documents of each
length. Only counts by length meet in one task, never documents.
"""

from __future__ import annotations

from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import small, stored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Words that are left to the dynamic programme, besides the shortest spare length; the second if the first don't do.
RESTS = (1 << 12, 1 << 16)
#: Lengths that it chooses from: half of them the shortest, half the longest.
MOST_LENGTHS = 2048
#: Rows of one source and length that are ranked together, on average, up to so many cells.
CELL_ROWS, MOST_CELLS = 1024, 4096
FITTED = "source string, size long, n long, source_size long, target double, copies int, extra long"


def nearest_sum(sizes: list[int], spare: list[int], left: int) -> list[int]:
    """How many of each size to take, ``spare`` at most, so that the sum is as near to ``left`` as can be; the lower of two.

    Sums are bits of one integer; the state before each size is kept, and the
    chosen sum is walked back through them.
    """
    taken = [0] * len(sizes)
    most = 2 * left  # what lies beyond is farther off than 0
    some = [i for i, m in enumerate(spare) if m > 0 and sizes[i] <= most]
    if left <= 0 or not some:
        return taken
    if len(some) > MOST_LENGTHS:
        some = some[: MOST_LENGTHS // 2] + some[-MOST_LENGTHS // 2 :]
    step = gcd(*(sizes[i] for i in some))
    best = (left + (step - 1) // 2) // step * step
    mask = (1 << most + 1) - 1
    reach, before = 1, []
    for i in reversed(some):
        before.append((i, reach))
        copies, k = min(spare[i], most // sizes[i]), 1
        while copies:
            k = min(k, copies)
            reach |= reach << k * sizes[i] & mask
            copies -= k
            k *= 2
        if reach >> best & 1:
            break
    at = next(s for d in range(most + 1) for s in (left - d, left + d) if s >= 0 and reach >> s & 1)
    for i, had in reversed(before):
        while not had >> at & 1:
            at -= sizes[i]
            taken[i] += 1
    return taken


def fitted(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length (positive, ascending) to take so that their words come near to ``budget``, which is below their sum.

    All but the last words are taken in proportion to the counts, so that the
    lengths keep their shares; more is left to the programme if it can't fit
    what it has.
    """
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    words = lambda taken: sum(s * k for s, k in zip(sizes, taken, strict=True))
    tried = []
    for rest in RESTS:
        taken = [n * max(0, budget - rest) // total for n in counts]
        left = budget - words(taken)
        for i in range(len(sizes) - 1, -1, -1):
            if left - rest >= sizes[i]:
                more = min(counts[i] - taken[i], (left - rest) // sizes[i])
                taken[i] += more
                left -= more * sizes[i]
        last = nearest_sum(sizes, [n - k for n, k in zip(counts, taken, strict=True)], left)
        tried.append([a + b for a, b in zip(taken, last, strict=True)])
        if words(tried[-1]) == budget or rest >= budget:
            break
    return min(tried, key=lambda taken: abs(words(taken) - budget))


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """Copies of each document and further documents by length, for the lengths of one source."""
    frame = frame.sort_values("size").reset_index(drop=True)
    total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    copies = int(target // total) if total else 0
    budget = round(target - copies * total)
    if total and budget >= total:
        copies, budget = copies + 1, 0
    held = [(i, int(s), int(n)) for i, (s, n) in enumerate(zip(frame["size"], frame["n"], strict=True)) if s > 0]
    extra = [0] * len(frame)
    if budget > 0:
        for (i, _, _), k in zip(held, fitted([s for _, s, _ in held], [n for _, _, n in held], budget), strict=True):
            extra[i] = k
    return frame.assign(copies=copies, extra=extra)[["source", "size", "n", "source_size", "target", "copies", "extra"]]


def targets(lengths: DataFrame) -> DataFrame:
    """(source, source_size, target): weights by rank, stopped at MOST_COPIES times a source's size, the excess reshared.

    Ranks come from ranges of sources and their counts. Each round of the
    resharing is one aggregate of two numbers; a source that has reached its
    stop stays there, so rounds end.
    """
    spark = lengths.sparkSession
    last = F.col("source").asc_nulls_last()
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranges = stored(sizes.repartitionByRange(last).withColumn("range", F.spark_partition_id()), "source-ranges")
    before, starts = 0, []
    for r in ranges.groupBy("range").count().orderBy("range").collect():
        starts.append((r["range"], before))
        before += r["count"]
    starts = spark.createDataFrame(starts, "range int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(last)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = stored(ranges.join(F.broadcast(starts), "range").select("source", "source_size", weight.alias("weight")), "source-weights")
    stop = MOST_COPIES * F.col("source_size")
    left, free = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, left, free = left or 0, left or 0, free or 1
    while True:
        share = F.lit(left) * F.col("weight") / F.lit(free)
        capped, open_ = weighed.agg(F.sum(F.when(stop <= share, stop)), F.sum(F.when(stop > share, F.col("weight")))).first()
        if open_ is None or (total - (capped or 0), open_) == (left, free):
            break
        left, free = total - (capped or 0), open_
    return weighed.select("source", "source_size", F.least(stop.cast("double"), share).alias("target"))


def mix_rows(rows: DataFrame, *, seed: int = 12, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, source_size, target, copies, taken): how often the mix takes each row, and the words that makes.

    ``rows`` have a string ``source`` and a long ``size`` (words); whatever
    their columns, they come back in the struct ``row``. Null sources are one
    source, ranked last. Rows without words are taken as often as their
    source's whole rounds, for no words; a null size counts as none. Rows of
    one length are ranked by a seeded hash of the columns in ``order`` and then
    by those columns, so reruns agree but for rows that agree in all of them. A
    source with one row goes as near to its target as copies of it allow. An
    empty table gives an empty result.
    """
    size = F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))
    cell = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order]), 33)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"), cell.alias("at"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("tie"))
    lengths = stored(packed.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    goals = stored(targets(lengths), "targets")
    met = lengths.alias("l").join(goals.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.*", "source_size", "target", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("extra"))
    fits = met.groupBy("source").applyInPandas(_fit, FITTED)
    cells = F.least(F.lit(MOST_CELLS), F.ceil(F.col("n") / CELL_ROWS)).cast("long")
    fits = stored(fits.select("*", F.monotonically_increasing_id().alias("fit"), cells.alias("cells")), "fits")

    same = F.col("p.source").eqNullSafe(F.col("f.source")) & (F.col("p.size") == F.col("f.size"))
    known = packed.alias("p").join(small(fits).alias("f"), same).select("row", "p.size", "at", "tie", "fit", "n", "source_size", "target", "copies", "extra", F.shiftright(F.col("at") * F.col("cells"), 31).alias("cell"))
    cut = known.where("extra > 0 and extra < n")
    counts = cut.groupBy("fit", "cell").agg(F.count("*").alias("held"))
    below = F.sum("held").over(Window.partitionBy("fit").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    below = counts.select("fit", "cell", F.coalesce(below, F.lit(0)).alias("below"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("fit", "cell").orderBy("at", "tie")))
    chosen = ranked.join(below, ["fit", "cell"]).withColumn("copies", F.col("copies") + (F.col("below") + F.col("rank") <= F.col("extra")).cast("int"))
    sure = known.where("not (extra > 0 and extra < n)").withColumn("copies", F.col("copies") + (F.col("extra") > 0).cast("int"))
    told = ["row", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return sure.select(*told).unionByName(chosen.select(*told))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words of the text; a null text has none."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("size", words.cast("long"))


def repeated(mix: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix_rows`` as often as it is taken."""
    return mix.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*", "copy")
