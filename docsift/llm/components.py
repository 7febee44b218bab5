"""Connected components of links, with alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import dropped, stored


class Forest:
    """Union-find over hashable ids inside one task."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, x, y) -> bool:
        """True if x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        low, high = (x, y) if x < y else (y, x)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True

    def edges(self) -> list:
        """(member, root) for each member that isn't a root itself."""
        return [(x, top) for x in list(self.up) if (top := self.root(x)) != x]


def _star(edges: DataFrame, small_step: bool) -> DataFrame:
    both = edges if small_step else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    near = both.join(lowest, "u")
    if small_step:
        out = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lowest.select("u", F.col("low").alias("v")))
    else:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns).

    The component is the smallest node reachable. Loops, repeated edges and
    nulls are ignored; an empty table gives an empty result. Each round writes
    its edges to the shared folder, so no round depends on a lost executor.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("ok"))
    now = stored(now.where("ok and u > v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        before, now = now, stored(_star(_star(now, False), True), "edges")
        dropped(before)
    # at the end every edge points from a node to the smallest node of its star
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
