"""Upkeep of gold values, vocabularies and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import ascii_label, clean_gold_label, join_notes, norm_alias, same_value

#: What names a regulator, after notes that only mention one are removed.
REGULATOR = r"(?iU)\bREGULATOR\b|DIRECT\s*OPERATED|SELF\s*OPERATED|PRESSURE\s*REDUCING|감압"


def equipment_class(name: Column) -> Column:
    """regulator, valve, or unknown for a blank name."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "unknown").when(name.rlike(REGULATOR), "regulator").otherwise("valve")


def label_candidates(gold: DataFrame, index: DataFrame, composites: DataFrame) -> DataFrame:
    """Source labels (doc_id, field_key, raw_label) that no field knows yet: n, docs and whether fields collide.

    A label of several fields collides unless it is a composite one.
    """
    cleaned = gold.withColumn("label", clean_gold_label(F.col("raw_label"))).withColumn("norm", ascii_label(F.col("label"))).where("norm <> ''")
    known = F.broadcast(index.select("field_key", ascii_label(F.col("label")).alias("norm")).distinct())
    split = F.broadcast(composites.select(ascii_label(F.col("label")).alias("norm"), F.lit(True).alias("composite")).distinct())
    fields = cleaned.groupBy("norm").agg(F.count_distinct("field_key").alias("fields"))
    new = cleaned.join(known, ["field_key", "norm"], "left_anti")
    counted = new.groupBy("field_key", "norm").agg(F.min("label").alias("label"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    met = counted.join(fields, "norm").join(split, "norm", "left")
    return met.select("field_key", "label", "n", "docs", ((F.col("fields") > 1) & F.col("composite").isNull()).alias("collides"))


def unreachable(gold: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """Gold values of fields with a vocabulary that neither are a known value nor lead to one by an alias: field_key, value, n."""
    norm = lambda c: norm_alias(c, F.lit(True))
    has = F.broadcast(vocabulary.select("field_key").distinct())
    direct = vocabulary.select("field_key", norm(F.col("value")).alias("norm"))
    by_alias = aliases.where("not compare_only").join(F.broadcast(vocabulary.select("field_key", F.col("value").alias("to"))), ["field_key", "to"]).select("field_key", norm(F.col("raw")).alias("norm"))
    reached = F.broadcast(direct.unionByName(by_alias).distinct())
    rest = gold.join(has, "field_key", "left_semi").withColumn("norm", norm(F.col("truth"))).where("norm <> ''").join(reached, ["field_key", "norm"], "left_anti")
    return rest.groupBy("field_key", "norm").agg(F.min("truth").alias("value"), F.count("*").alias("n")).drop("norm")


def gold_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, field_key, change, before, after) of values added, removed or changed between two gold tables."""
    a = before.select("doc_id", "field_key", F.col("truth").alias("before"), F.lit(True).alias("was"))
    b = after.select("doc_id", "field_key", F.col("truth").alias("after"), F.lit(True).alias("now"))
    met = a.join(b, ["doc_id", "field_key"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return met.withColumn("change", change).where("change is not null").select("doc_id", "field_key", "change", "before", "after")


def escalations(records: DataFrame, file_tags: DataFrame, tag_field: str = "tag") -> DataFrame:
    """Records to read again and why: low confidence, a required field without value, a tag that isn't the file's.

    ``file_tags`` has doc_id and tags (array); a document without tags has no mismatch.
    """
    met = records.join(file_tags, "doc_id", "left")
    off = (F.col("field_key") == tag_field) & F.col("value").isNotNull() & (F.size(F.coalesce("tags", F.array())) > 0) & ~F.array_contains("tags", F.col("value"))
    why = join_notes(F.when(F.col("confidence") < F.col("threshold"), "LOW_CONFIDENCE"), F.when(F.col("required") & F.col("value").isNull(), "MISSING"), F.when(off, "TAG_MISMATCH"))
    return met.withColumn("why", why).where("why <> ''").select("doc_id", "field_key", "value", "why")


def settle(first: Column, second: Column, numeric: Column | None = None) -> Column:
    """kept without a second reading, agree if both are the same value, else changed."""
    return F.when(second.isNull(), "kept").when(same_value(first, second, numeric), "agree").otherwise("changed")


def append_history(summary: DataFrame, run_id: str, path: str) -> None:
    """One row for each run, in a table; a report is rendered from it on demand."""
    summary.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def approved_rules(decisions: DataFrame) -> DataFrame:
    """Approved candidates (field_key, value, to, correctable) as rule lines by field: aliases where a value may be corrected, else known values."""
    line = F.when(F.col("correctable") & F.col("to").isNotNull(), F.format_string('- {from: ["%s"], to: "%s"}', "value", "to")).otherwise(F.format_string('- "%s"', "value"))
    block = F.when(F.col("correctable") & F.col("to").isNotNull(), "value_aliases").otherwise("flag_only")
    return decisions.groupBy(block.alias("block"), "field_key").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("lines"))
