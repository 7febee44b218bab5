"""How filters act on each other: every order of five filters, from the edges of their lattice.

What a filter removes depends on the set of filters applied before it, not on
their order. There are 80 pairs of such a set and a next filter, and each of
the 600 steps of the 120 orders is one of them. A document's part in all edges
follows from which filters it fails, so documents are counted by failures first
and the counts contribute to the edges.
"""

from __future__ import annotations

import json
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import UPPER

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
EDGE = "array<struct<applied:int,filter:int,orders:bigint>>"
STEP = "array<struct<filter_order:string,step:int,applied:int,filter:int>>"


def bits(letters) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


def edges() -> list[dict]:
    """The 80 edges, with the number of orders that run through each."""
    found = []
    for f in FILTERS:
        rest = [x for x in FILTERS if x != f]
        for k in range(len(FILTERS)):
            found += [{"applied": bits(s), "filter": bits(f), "orders": factorial(k) * factorial(len(rest) - k)} for s in combinations(rest, k)]
    return found


def steps() -> list[dict]:
    return [{"filter_order": "".join(p), "step": i + 1, "applied": bits(p[:i]), "filter": bits(p[i])} for p in permutations(FILTERS) for i in range(len(p))]


def failed(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, chars = F.size(words), F.length(text)
    tests = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * (chars - F.length(F.translate(text, UPPER, ""))) > 3 * chars,
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def fail_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents by the filters they fail.

    Texts become digests before anything is shuffled. Rows of one document and
    text are counted together, so that a copied text or id is as many rows as
    it has parts, and the smallest id of a text is found among those counts.
    """
    text = F.coalesce("text", F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed(text).alias("failed"))
    told = told.groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    good, toxic = (F.bool_or(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(good, toxic)
    no = F.lit(False)
    told = told.join(known, "id", "left").select("id", "part", "digest", "failed", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # a group's rows under its own smallest id, and those without an id, are the only ones that can pass E
    groups = told.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    passed = F.col("unnamed") + F.when(F.col("low") == F.col("first"), F.col("at_low")).otherwise(0)
    counted = groups.withColumn("first", first).withColumn("passed", passed)
    two = F.array(F.struct(F.col("failed"), F.col("passed").alias("n")), F.struct((F.col("failed") + bits("E")).alias("failed"), (F.col("n") - F.col("passed")).alias("n")))
    return counted.select("part", "good", "toxic", F.inline(two)).groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def edge_counts(counts: DataFrame) -> DataFrame:
    """Each part's 80 edges with what their filter does behind their applied set."""
    lattice = F.inline(F.from_json(F.lit(json.dumps(edges())), EDGE))
    met = counts.select("part", "failed", "good", "toxic", "n", lattice)
    alive, fails = F.expr("failed & applied = 0"), F.expr("failed & filter != 0")
    number = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return met.groupBy("part", "applied", "filter").agg(
        F.first("orders").alias("orders"), number(alive & ~fails).alias("kept"), number(alive & fails).alias("removed"), number(~alive & fails).alias("redundant"),
        number(F.col("failed") == F.col("filter")).alias("unique_fails"), number(alive & fails & F.col("good")).alias("good_lost"), number(alive & fails & F.col("toxic")).alias("toxic_lost"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part and step.

    A null text is the empty text, a null lang the empty part; whole texts
    count. A row fails E if its text is that of a smaller doc_id: rows that
    share the smallest id pass, and rows without an id pass and stand before
    none. Rows of one doc_id count each; of several labels of a document any 1
    counts, and one without a label is neither good nor toxic. Other columns
    are ignored. An empty table gives an empty result.
    """
    at = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(steps())), STEP)))
    shapley = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter"))
    found = edge_counts(fail_counts(docs, labels)).withColumn("shapley", shapley)
    return found.join(F.broadcast(at), ["applied", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
