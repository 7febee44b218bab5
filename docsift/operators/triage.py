"""Page triage: structure statistics, page classes, the latest specification page, and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import strip

TEXT_LAYER = 100
MARK_ORDER = ("AS-BUILT", "RETROFIT", "REVISED")


def has_text_layer(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) >= TEXT_LAYER, F.lit(False))


def probe_structure(pages: DataFrame) -> DataFrame:
    """Per doc_id: page_count, text_pages, sum and longest text_len, mixed, the first 20 pages as locators."""
    length = F.length(F.coalesce("text", F.lit("")))
    return (
        pages.withColumn("layer", has_text_layer(F.col("text")))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("page_count"),
            F.count_if("layer").alias("text_pages"),
            F.sum(length).alias("text_len"),
            F.max(length).alias("max_text_len"),
            F.slice(F.sort_array(F.collect_list("page")), 1, 20).alias("first_pages"),
        )
        .withColumn("mixed", (F.col("text_pages") > 0) & (F.col("text_pages") < F.col("page_count")))
    )


def looks_like_spec(text: Column, headers: list[str], report_headers: list[str], items: list[str], least: int = 2) -> Column:
    """Enough text, and a specification header, or a report header with at least ``least`` items of a specification."""
    flat = F.upper(F.regexp_replace(text, r"\s+", " "))
    has = lambda words: F.greatest(*[flat.contains(w) for w in words], F.lit(False))
    count = sum((flat.contains(w).cast("int") for w in items), F.lit(0))
    return F.coalesce((F.length(text) >= TEXT_LAYER) & (has(headers) | (has(report_headers) & (count >= least))), F.lit(False))


def _marked(mark: str):
    return lambda p: p["mark"] == mark


def pick_latest(pages: DataFrame) -> DataFrame:
    """The one page of each document that the rules can name, else none: (doc_id, page, rule).

    ``pages`` are candidates (doc_id, page, is_spec, superseded, tags
    array<string>, date_key struct<y,m,d>, date_ambiguous, mark, file_tag).
    Rules in turn: NO_SPEC, ONE_SPEC, ALL_SUPERSEDED, ONE_LIVE, FILE_TAG or
    MANY_ASSETS for pages of different tags, LATEST_YEAR, LATEST_DATE, the one
    page with a mark, UNDECIDED. Ties give no page. A document's candidates
    meet in one aggregate; nothing is ordered across documents.
    """
    page = F.struct("page", "tags", "superseded", "mark", F.coalesce(F.col("date_key.y"), F.lit(0)).alias("y"), F.coalesce("date_ambiguous", F.lit(False)).alias("unsure"), F.col("date_key").alias("key"))
    per = pages.groupBy("doc_id").agg(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("is_spec"), page)))).alias("specs"), F.max("file_tag").alias("file_tag"))
    live = F.filter("specs", lambda p: ~F.coalesce(p["superseded"], F.lit(False)))
    per = per.withColumn("live", live)
    tagged = F.forall("live", lambda p: F.size(F.coalesce(p["tags"], F.array())) > 0)
    shared = F.aggregate(F.slice("live", 2, F.greatest(F.size("live"), F.lit(1))), F.element_at("live", 1)["tags"], lambda a, p: F.array_intersect(a, p["tags"]))
    apart = tagged & (F.size(shared) == 0)
    own = F.filter("live", lambda p: F.coalesce(F.array_contains(p["tags"], F.col("file_tag")), F.lit(False)))
    dated = F.filter("live", lambda p: p["y"] > 0)
    top = F.array_max(F.transform(dated, lambda p: p["y"]))
    per = per.withColumns({"apart": F.when(F.size("live") > 1, apart).otherwise(F.lit(False)), "own": own, "newest": F.filter(dated, lambda p: p["y"] == top)})
    sure = ~F.exists("newest", lambda p: p["unsure"])
    last = F.array_max(F.transform("newest", lambda p: p["key"]))
    per = per.withColumn("best", F.filter("newest", lambda p: p["key"] == last)).withColumn("rest", F.when(F.size("newest") > 0, F.col("newest")).otherwise(F.col("live")))
    one = lambda c: F.element_at(c, 1)["page"]
    name = lambda p, r: F.struct(p.alias("page"), F.lit(r).alias("rule"))
    none = F.lit(None).cast(pages.schema["page"].dataType)
    rule = (
        F.when(F.size("specs") == 0, name(none, "NO_SPEC"))
        .when(F.size("specs") == 1, name(one("specs"), "ONE_SPEC"))
        .when(F.size("live") == 0, name(none, "ALL_SUPERSEDED"))
        .when(F.size("live") == 1, name(one("live"), "ONE_LIVE"))
        .when(F.col("apart") & (F.size("own") == 1), name(one("own"), "FILE_TAG"))
        .when(F.col("apart"), name(none, "MANY_ASSETS"))
        .when(F.size("newest") == 1, name(one("newest"), "LATEST_YEAR"))
        .when((F.size("newest") > 1) & sure & (F.size("best") == 1), name(one("best"), "LATEST_DATE"))
    )
    for mark in MARK_ORDER:
        hit = F.filter("rest", _marked(mark))
        rule = rule.when(F.size(hit) == 1, name(one(hit), mark))
    return per.select("doc_id", rule.otherwise(name(none, "UNDECIDED")).alias("pick")).select("doc_id", "pick.page", "pick.rule")


def triage(files: DataFrame, pages: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, document_class, confidence, page, reason) of each file.

    ``files`` has doc_id, supported, in_scope (null if the name doesn't tell);
    ``pages`` has doc_id, is_spec, rendered and text.
    """
    seen = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("is_spec").alias("specs"), F.max("rendered").alias("rendered"), F.max(has_text_layer(F.col("text"))).alias("texted"))
    met = files.join(seen, "doc_id", "left").join(picked, "doc_id", "left").na.fill(0, ["n", "specs"])
    told = lambda kind, sure, why: F.struct(F.lit(kind).alias("document_class"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    embedded = (F.col("specs") > 0) & (F.col("specs") < F.col("n")) & (F.col("n") > 1)
    out = (
        F.when(~F.col("supported"), told("unsupported", 1.0, "EXTENSION"))
        .when(~F.coalesce("in_scope", F.lit(True)), told("out_of_scope", 0.95, "FILE_NAME"))
        .when(F.col("page").isNotNull() & embedded, told("datasheet_embedded", 0.9, "SELECTED"))
        .when(F.col("page").isNotNull(), told("datasheet", 0.9, "SELECTED"))
        .when(F.col("specs") > 1, told("datasheet_embedded", 0.3, "AMBIGUOUS"))
        .when(~F.coalesce("texted", F.lit(False)) & F.coalesce("rendered", F.lit(False)), told("datasheet", 0.45, "SCAN"))
        .otherwise(told("out_of_scope", 0.2, "NOTHING"))
    )
    return met.select("doc_id", out.alias("t"), "page").select("doc_id", "t.document_class", "t.confidence", "page", "t.reason")


def route(triaged: DataFrame, pages: DataFrame) -> DataFrame:
    """Work units (doc_id, page, parser, declined, text_hint): the picked page, or all pages of the document.

    Spreadsheets go to the grid parser and all else to the reader; documents
    that can't be processed have parser null.
    """
    fine = F.col("document_class").isin("datasheet", "datasheet_embedded")
    specs = Window.partitionBy("doc_id")
    met = triaged.withColumnRenamed("page", "picked").join(pages, "doc_id")
    met = met.withColumn("declined", (F.count_if("is_spec").over(specs) > 1) & F.col("picked").isNull())
    units = met.where(F.col("picked").isNull() | (F.col("picked") == F.col("page")))
    parser = F.when(~fine, F.lit(None).cast("string")).when(F.lower("extension").isin("xlsx", "xlsm", "xls"), "excel").otherwise("vlm")
    return units.select("doc_id", "page", parser.alias("parser"), "declined", has_text_layer(F.col("text")).alias("text_hint"))


def stale_files(files: DataFrame) -> DataFrame:
    """Files (doc_id, tag, doc_kind) whose tag has a report file besides them."""
    reports = files.where(F.col("doc_kind").isin("repair_report", "retrofit_report", "retrofit")).select(F.col("doc_id").alias("report_id"), F.col("tag").alias("report_tag"))
    return files.join(reports, (F.col("tag") == F.col("report_tag")) & (F.col("doc_id") != F.col("report_id")), "left_semi")
