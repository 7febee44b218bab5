"""Vocabulary and provenance flags, candidates for new values, and nearest known values."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.text import ascii_label, found, norm_alias, norm_label, strip

#: Sources of a value that are weak evidence, and labels that are strong evidence.
WEAK = r"(?i)logo|footer|header|letterhead|title\s*block"
STRONG = r"(?i)manufacturer|maker|mfr"


def _norm(c):
    return norm_alias(c, F.lit(True))


def in_vocabulary(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds known to rows (field_key, value): null where the field has no vocabulary or the value is null."""
    fields = F.broadcast(vocabulary.select("field_key", F.lit(True).alias("has")).distinct())
    values = F.broadcast(vocabulary.select("field_key", _norm(F.col("value")).alias("norm_"), F.lit(True).alias("hit")).distinct())
    met = rows.withColumn("norm_", _norm(F.col("value"))).join(fields, "field_key", "left").join(values, ["field_key", "norm_"], "left")
    return met.withColumn("known", F.when(F.col("has") & F.col("value").isNotNull(), F.coalesce("hit", F.lit(False)))).drop("norm_", "has", "hit")


def candidates(rows: DataFrame, min_count: int = 1) -> DataFrame:
    """Values outside the vocabulary: field_key, value (first seen), n, docs, first documents and labels; most frequent first.

    ``rows`` has doc_id, field_key, value, label, seq (order of arrival).
    """
    keyed = rows.withColumn("norm_", _norm(F.col("value")))
    # distinct first, so that a frequent value gathers few rows: the first place of each document and label
    docs = keyed.groupBy("field_key", "norm_", "doc_id").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min_by("value", "seq").alias("value"))
    labels = keyed.groupBy("field_key", "norm_", "label").agg(F.min("seq").alias("seq"))
    group = ["field_key", "norm_"]

    def first(of: DataFrame, name: str, k: int) -> DataFrame:
        # the filter on the rank lets Spark cut each group before the shuffle, so a frequent value isn't sorted whole in one task
        ranked = of.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("seq"))).where(F.col("rank") <= k)
        return ranked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("seq", name))).alias(name))

    per_doc = docs.groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min_by("value", "seq").alias("value")).join(first(docs, "doc_id", 6).withColumnRenamed("doc_id", "d"), group)
    per_label = first(labels, "label", 3).withColumnRenamed("label", "l")
    met = per_doc.where(F.col("n") >= min_count).join(per_label, ["field_key", "norm_"])
    return met.select("field_key", "value", "n", "docs", F.transform("d", lambda x: x["doc_id"]).alias("first_docs"), F.transform("l", lambda x: x["label"]).alias("first_labels")).orderBy(F.desc("n"), "field_key", "value")


def _tokens(norm: Column) -> Column:
    """The characters of a text, each with its turn among its equals, rarest turns first; an empty text has one empty token.

    Two texts share as many tokens as characters, in any order, which is at
    least what their matching blocks hold.
    """
    chars = F.array_sort(F.filter(F.split(norm, ""), lambda c: c != ""))
    turn = lambda c, i: F.struct((F.array_position(chars, c) - i - 1).alias("turn"), c.alias("char"))
    return F.when(norm == "", F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("").alias("char")))).otherwise(F.array_sort(F.transform(chars, turn)))


def _prefix(norm: Column, tokens: Column, least: float) -> Column:
    """The tokens of which any text with a ratio of ``least`` must have one among its own first: all but so many as must be shared, less one."""
    n = F.length(norm)
    shortest = F.ceil(n * least / (2 - least) - 1e-9)
    return F.slice(tokens, F.lit(1), F.greatest(F.lit(1), (n - F.ceil(least * (n + shortest) / 2 - 1e-9) + 1).cast("int")))


def matching_ratio(a: str, b: str) -> Column:
    """Longest-matching-blocks similarity of two columns, for which Spark has no expression."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def _pairs(values: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs of (value, norm) and (name, ord, known_norm) that can have a ratio of ``least``: their lengths and characters allow it.

    An inverted index by the rarest tokens brings them together, and shared
    characters are counted before any pair is compared.
    """
    keyed = lambda rows, norm, token: rows.withColumn(f"{token}s", _tokens(F.col(norm))).withColumn(token, F.explode(_prefix(F.col(norm), F.col(f"{token}s"), least)))
    met = keyed(values, "norm", "token").join(keyed(known, "known_norm", "mark"), F.col("token") == F.col("mark"))
    n, m = F.length("norm"), F.length("known_norm")
    enough = F.when((n == 0) & (m == 0), True).otherwise(2 * F.size(F.array_intersect("tokens", "marks")) >= least * (n + m) - 1e-9)
    return met.where(enough & (2 * F.least(n, m) >= least * (n + m) - 1e-9)).select("value", "norm", "name", "ord", "known_norm").distinct()


def _known(spark: SparkSession, names: list[str], norm) -> DataFrame:
    rows = [(name, i) for i, name in enumerate(dict.fromkeys(names))]
    return spark.createDataFrame(rows, "name string, ord int").withColumn("known_norm", norm(F.col("name")))


def nearest(values: DataFrame, vocabulary: list[str], least: float = 0.7) -> DataFrame:
    """Adds nearest to values (value): the known value of the highest matching ratio, null below ``least`` or on a tie.

    Distinct values alone are compared, each with the known values that its
    characters allow; what is left out can't reach ``least``.
    """
    told = values.where("value is not null").select("value", norm_label(F.col("value")).alias("norm")).distinct()
    pairs = _pairs(told, _known(values.sparkSession, vocabulary, norm_label), least).withColumn("ratio", matching_ratio("norm", "known_norm"))
    two = F.slice(F.sort_array(F.collect_list(F.struct("ratio", "name")), asc=False), 1, 2)
    best = pairs.where(F.col("ratio") >= least).groupBy("value").agg(two.alias("two"))
    tied = (F.size("two") > 1) & (F.get("two", F.lit(0))["ratio"] - F.get("two", F.lit(1))["ratio"] < 1e-9)
    return values.join(best.select("value", F.when(~tied, F.get("two", F.lit(0))["name"]).alias("nearest")), "value", "left")


#: A part of a name counts from so many characters, and a label from so many.
PART_CHARS, LABEL_CHARS = 4, 3


def suggest(labels: DataFrame, names: list[str], least: float = 0.62) -> DataFrame:
    """Adds suggestion and ratio to labels (label): the name of the highest matching ratio, the first of several.

    A name that holds the label, or is held, scores 0.60 + 0.35 of the covered
    share where both have four characters; such pairs meet by the held one's
    first four. Labels of less than three characters get nothing.
    """
    told = labels.select(F.col("label").alias("value")).where("label is not null").distinct().withColumn("norm", ascii_label(F.col("value"))).where(F.length("norm") >= LABEL_CHARS)
    known = _known(labels.sparkSession, names, ascii_label).where("known_norm <> ''")
    grams = lambda norm: F.when(F.length(norm) >= PART_CHARS, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(norm) - PART_CHARS + 1), lambda i: F.substring(norm, i, F.lit(PART_CHARS)))))
    first = lambda norm: F.when(F.length(norm) >= PART_CHARS, F.array(F.substring(norm, 1, PART_CHARS)))
    held = lambda whole, part: whole(told, F.col("norm")).join(part(known, F.col("known_norm")), "gram").drop("gram")
    by = lambda cut: lambda rows, norm: rows.withColumn("gram", F.explode(cut(norm)))
    pairs = _pairs(told, known, least).unionByName(held(by(grams), by(first))).unionByName(held(by(first), by(grams))).distinct()
    n, m = F.length("norm"), F.length("known_norm")
    part = (F.least(n, m) >= PART_CHARS) & (F.contains("norm", "known_norm") | F.contains("known_norm", "norm"))
    ratio = matching_ratio("norm", "known_norm")
    pairs = pairs.withColumn("ratio", ratio).withColumn("ratio", F.when(part, F.greatest("ratio", 0.60 + 0.35 * F.least(n, m) / F.greatest(n, m))).otherwise(F.col("ratio")))
    best = pairs.where(F.col("ratio") >= least).groupBy(F.col("value").alias("label")).agg(F.max_by(F.struct(F.col("name").alias("suggestion"), F.bround("ratio", 2).alias("ratio")), F.struct("ratio", -F.col("ord"))).alias("best"))
    return labels.join(best.select("label", "best.*"), "label", "left")


def looks_composite(labels: DataFrame, names: list[str], least: float = 0.62) -> DataFrame:
    """Adds composite to labels (label): at least two parts between slashes, each with three ASCII letters, one of which suggests a name."""
    parts = F.filter(F.transform(F.split("label", "/"), strip), lambda p: p != "")
    wordy = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= LABEL_CHARS)
    told = labels.select(F.col("label").alias("whole")).distinct().withColumn("label", F.col("whole")).where(wordy).select("whole", F.explode(parts).alias("label"))
    hit = suggest(told, names, least).groupBy(F.col("whole").alias("label")).agg(F.bool_or(F.col("suggestion").isNotNull()).alias("hit"))
    return labels.join(hit, "label", "left").withColumn("composite", F.coalesce("hit", F.lit(False))).drop("hit")


def better_sources(records: DataFrame, field_key: str) -> DataFrame:
    """(doc_id, field_key, source_field, source_value, source_label) where a field was read from weak evidence though another has strong.

    Of the document's other fields with a value and a label that is strong and
    not weak, the first by ``ord`` is named. A document has as many fields as
    the rules, so few rows meet in its group.
    """
    named = records.where(F.col("raw_value").isNotNull() & (F.col("raw_value") != ""))
    strong = named.where(F.col("raw_label").rlike(STRONG) & ~F.col("raw_label").rlike(WEAK) & (F.col("field_key") != field_key))
    first = strong.groupBy("doc_id").agg(F.min_by(F.struct(F.col("field_key").alias("source_field"), F.col("raw_value").alias("source_value"), F.col("raw_label").alias("source_label")), F.struct("ord", "field_key")).alias("s"))
    weak = records.where((F.col("field_key") == field_key) & found(F.col("value")) & F.col("raw_label").rlike(WEAK)).select("doc_id", "field_key")
    return weak.join(first, "doc_id").select("doc_id", "field_key", "s.*")


def flags(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, field_key, source) with source CONFIDENCE, VOCAB or PROVENANCE; a record may have all three.

    PROVENANCE: the value's label is a weak source and another field of the
    document has the same kind of value under a strong label.
    """
    told = in_vocabulary(records, vocabulary)
    strong = told.where(F.col("raw_label").rlike(STRONG) & F.col("value").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("strong"))
    met = told.join(strong, "doc_id", "left")
    weak = F.col("raw_label").rlike(WEAK) & F.coalesce(F.col("strong") > 0, F.lit(False))
    kinds = F.array_compact(F.array(F.when(F.col("confidence") < F.col("threshold"), "CONFIDENCE"), F.when(~F.col("known"), "VOCAB"), F.when(weak, "PROVENANCE")))
    return met.where(F.col("value").isNotNull()).select("doc_id", "field_key", F.explode(kinds).alias("source"))


def label_stats(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Labels (file, label) that no field knows: n and files by normal form, most frequent first."""
    norm = F.regexp_replace(F.upper(strip(F.col("label"))), "[^0-9A-Z]+", "")
    known = F.broadcast(index.select(F.regexp_replace(F.upper("label"), "[^0-9A-Z]+", "").alias("norm")).distinct())
    rest = labels.withColumn("norm", norm).where("norm <> ''").join(known, "norm", "left_anti")
    return rest.groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.min("label").alias("label")).orderBy(F.desc("n"), "norm")
