"""Comparison of two readings of one document, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import EMPTY_VALUES, compat, join_notes, norm_label, same_forms, strip, with_forms

STATES = ("AGREE", "NOTATION", "CONFLICT", "VLM_ONLY", "TEXT_ONLY", "NEITHER")


def _known(c: Column) -> Column:
    return F.when(~F.upper(strip(c)).isin(*EMPTY_VALUES), c)


def with_standard(rows: DataFrame, column: str, aliases: DataFrame, name: str | None = None) -> DataFrame:
    """Adds the standard form of a value by its field's aliases (field_key, raw, to, ord), the value itself where none fits.

    Unlike the normaliser's, the keys drop all punctuation, so FAIL-CLOSE is
    FAIL CLOSE, and aliases for comparison only count.
    """
    name = name or f"{column}_std"
    norm = lambda c: norm_label(compat(c))
    table = aliases.select("field_key", norm(F.col("raw")).alias("norm_"), "to", "ord").groupBy("field_key", "norm_").agg(F.min_by("to", "ord").alias(name))
    met = rows.withColumn("norm_", norm(F.col(column))).join(F.broadcast(table), ["field_key", "norm_"], "left")
    return met.withColumn(name, F.coalesce(name, column)).drop("norm_")


def crosscheck(vlm: DataFrame, text: DataFrame, wanted: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(doc_id, field_key, vlm_value, text_value, state): a full outer join within the fields wanted.

    ``wanted`` has field_key and numeric. ``aliases`` (field_key, raw, to) give
    both values' standard form, those for comparison only included.
    """
    a = vlm.select("doc_id", "field_key", _known(F.col("value")).alias("vlm_value"))
    b = text.select("doc_id", "field_key", _known(F.col("value")).alias("text_value"))
    met = a.join(b, ["doc_id", "field_key"], "full_outer").join(F.broadcast(wanted.select("field_key", "numeric")), "field_key")
    names = ["vlm_value", "text_value"]
    if aliases is not None:
        met = with_standard(with_standard(met, "vlm_value", aliases, "vlm_std"), "text_value", aliases, "text_std")
        names += ["vlm_std", "text_std"]
    met, forms = with_forms(met, *names)
    numeric = F.col("numeric")
    state = (
        F.when(F.col("vlm_value").isNull() & F.col("text_value").isNull(), "NEITHER")
        .when(F.col("text_value").isNull(), "VLM_ONLY")
        .when(F.col("vlm_value").isNull(), "TEXT_ONLY")
        .when(same_forms(*forms[:2], numeric) | same_forms(*forms[-2:], numeric), "AGREE")
        .when(same_forms(*forms[:2], F.lit(True)), "NOTATION")
        .otherwise("CONFLICT")
    )
    return met.select("doc_id", "field_key", "vlm_value", "text_value", state.alias("state"))


def agreement(checked: DataFrame, *by: str) -> DataFrame:
    """Counts of each state and the rate of agreement where both read something, null if they never did."""
    n = {s: F.count_if(F.col("state") == s) for s in STATES}
    both = n["AGREE"] + n["NOTATION"] + n["CONFLICT"]
    rate = F.try_divide(n["AGREE"] + n["NOTATION"], both)
    return checked.groupBy(*by).agg(*[c.alias(s.lower()) for s, c in n.items()], rate.alias("rate"))


def merge(vlm: DataFrame, text: DataFrame, checked: DataFrame) -> DataFrame:
    """The reader's extractions after comparison: a conflict keeps its value without confidence, a gap takes the text's."""
    fill = text.select("doc_id", "field_key", *[F.col(c).alias(f"text_{c}") for c in ("label", "page")])
    met = checked.join(vlm.select("doc_id", "field_key", "label", "page", "confidence", "note"), ["doc_id", "field_key"], "left").join(fill, ["doc_id", "field_key"], "left")
    only = F.col("state") == "TEXT_ONLY"
    return met.select(
        "doc_id",
        "field_key",
        F.when(only, F.col("text_value")).otherwise(F.col("vlm_value")).alias("value"),
        F.when(only, F.col("text_label")).otherwise(F.col("label")).alias("label"),
        F.when(only, F.col("text_page")).otherwise(F.col("page")).alias("page"),
        F.when(F.col("state").isin("CONFLICT", "TEXT_ONLY"), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        join_notes(F.col("note"), F.col("state")).alias("note"),
    )
