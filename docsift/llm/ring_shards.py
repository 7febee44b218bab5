"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many points of a ring. A row goes to the first point
clockwise of its key's hash; where that point's shard is full, it continues to
the next point whose shard has room. Rows of an arc are alike but for their
order, so the walk is done once for the arcs' row counts (shards times virtual
nodes, a bound that the data don't touch), and each row finds its shard and
slot by its rank in its arc.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 40
POINTS = 128
RING = 1 << 32
PIECES = "array<struct<arc:int,low:bigint,high:bigint,shard:int,slot:bigint>>"


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard), in ring order; adding a shard leaves the others' points."""
    return sorted((int(hashlib.md5(f"{s}/{p}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for p in range(points))


def position(key: Column) -> Column:
    """A key's place on the ring: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def walk(counts: dict[int, int], shards: list[int], load: float, n_shards: int) -> list[dict]:
    """Where the rows of each arc go: pieces (arc, low, high, shard, slot) of ranks low <= r < high.

    Arcs take their turn in ring order. At a load of 1 the shards hold counts
    that differ by one at most: the first (rows mod shards) shards one more.
    """
    rows = sum(counts.values())
    most = -(-rows // n_shards) if load <= 1 else max(-(-rows // n_shards), int(load * rows / n_shards))
    room = [most if load > 1 or not rows % n_shards or s < rows % n_shards else most - 1 for s in range(n_shards)]
    used = [0] * n_shards
    pieces = []
    for arc in sorted(counts):
        done, at = 0, arc
        while done < counts[arc]:
            s = shards[at % len(shards)]
            n = min(counts[arc] - done, room[s] - used[s])
            if n:
                pieces.append({"arc": arc, "low": done, "high": done + n, "shard": s, "slot": used[s]})
                used[s] += n
                done += n
            at += 1
    return pieces


def _arc(at: Column, places: list[int]) -> Column:
    """The number of ring points before a position, modulo their count: the row's first point clockwise.

    The points are cut by their high bits, so a row compares with the few of its own cell.
    """
    cells = 1 << 12
    width = RING // cells
    starts = [bisect_left(places, c * width) for c in range(cells + 1)]
    table = [{"first": starts[c], "own": places[starts[c] : starts[c + 1]]} for c in range(cells)]
    cell = F.element_at(F.from_json(F.lit(json.dumps(table)), "array<struct<first:int,own:array<bigint>>>"), (F.floor(at / width) + 1).cast("int"))
    return ((cell["first"] + F.size(F.filter(cell["own"], lambda p: p < at))) % len(places)).cast("int")


def place_rows(rows: DataFrame, key: Column, order: list[Column], *, shards: int = SHARDS, points: int = POINTS, load: float = 1.0) -> DataFrame:
    """``rows`` with shard int and slot long (gapless from 0 in each shard) behind their columns.

    ``key`` is a non-null string that a row is hashed by and ``order`` breaks
    ties within an arc. ``load`` bounds a shard's rows to so many times the
    mean; 1 makes the counts equal but for one row. Whatever the rows' columns
    are called, they are left alone. Repeated rows get slots of their own, in
    any order; an empty table gives an empty result.
    """
    spark: SparkSession = rows.sparkSession
    stops = ring(shards, points)
    places, owners = [p for p, _ in stops], [s for _, s in stops]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), position(key).alias("at"), F.struct(*order).alias("tie"))
    packed = packed.withColumn("arc", _arc(F.col("at"), places))
    counts = {r["arc"]: r["n"] for r in packed.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    pieces = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(walk(counts, owners, load, shards))), PIECES)))
    ranked = packed.withColumn("rank", (F.row_number().over(Window.partitionBy("arc").orderBy("at", "tie")) - 1).cast("long"))
    met = ranked.alias("r").join(F.broadcast(pieces).alias("p"), (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return met.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"))


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): documents by a ring of bounded loads.

    The law is ``rows``: the shards' counts differ by one at most, so the load
    bound is met exactly. size is the text's UTF-8 bytes plus 16; a null text
    has none. grown_shard is null, as that law has no use for it. A null
    doc_id is a key of its own; repeated doc_ids and rows share their place on
    the ring and spill over from it when it is full. Other columns of ``docs``
    are ignored. An empty table gives an empty result.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    placed = place_rows(told, key, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards=shards, points=points)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
