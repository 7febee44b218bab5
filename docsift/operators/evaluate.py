"""Scoring of records against gold values, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import Forms, clean, is_na, same_forms, with_forms, without_forms

#: From worst to best.
VERDICTS = ("FABRICATED", "WRONG", "WRONG_PAGE", "MISSING", "PENDING_NORM", "EXACT")
DANGEROUS = ("FABRICATED", "WRONG", "PENDING_NORM")


#: What an error says that will come again with every document.
PERMANENT = ("insufficient_quota", "credit_balance_exhausted", "no credits remaining", "authenticationerror", "permissiondenied", "invalid_api_key", "account is not active")


def judge(truth: Column, got: Column, raw: Column, numeric: Column | None = None) -> Column:
    """The verdict on one cell. A raw reading that equals the truth is exact whatever became of it."""
    return _judge(Forms.of(truth), Forms.of(got), Forms.of(raw), got.isNull(), numeric)


def _judge(truth: Forms, got: Forms, raw: Forms, missing: Column, numeric: Column | None) -> Column:
    within = lambda x: (x.text != "") & truth.text.contains(x.text)
    return (
        F.when(is_na(truth.cleaned), F.when(missing | is_na(got.cleaned), "EXACT").otherwise("FABRICATED"))
        .when(missing, "MISSING")
        .when(same_forms(truth, got, numeric) | same_forms(truth, raw, numeric), "EXACT")
        .when(within(raw) | within(got), "PENDING_NORM")
        .otherwise("WRONG")
    )


def choose_rows(rows: DataFrame, *, only: list[str] | None = None, labelers: list[str] | None = None, drafts: str | None = None, limit: int | None = None) -> DataFrame:
    """Gold documents (ord, doc_id, labeler) to score: those named, those of a labeler and not a machine's draft, the first so many in order."""
    if only is not None:
        rows = rows.where(F.col("doc_id").cast("string").isin([str(x) for x in only]))
    if labelers is not None or drafts is not None:
        rows = rows.where(F.coalesce(F.trim("labeler"), F.lit("")) != "")
    if drafts is not None:
        rows = rows.where(~F.col("labeler").contains(drafts))
    if labelers is not None:
        rows = rows.where(F.col("labeler").isin(labelers))
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def document_status(rows: DataFrame, outcomes: DataFrame, holdout: DataFrame | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """Adds status and reason to documents (group, ord, doc_id, path, spec_page) by their outcomes (group, doc_id, error, page).

    HOLDOUT, NO_FILE, FAILED, WRONG_PAGE or SCORED. A permanent error ends its
    run: all documents behind the first one are STOPPED, and held-out ones
    there aren't told at all. Where the run ends is one number for each run,
    the least place of such an error, so no run is ordered in one task.
    """
    met = rows.join(outcomes.select(*group, "doc_id", "error", F.col("page").alias("got_page")), [*group, "doc_id"], "left")
    held = F.lit(False)
    if holdout is not None:
        met = met.join(holdout.select("doc_id", F.lit(True).alias("held_")).distinct(), "doc_id", "left")
        held = F.coalesce("held_", F.lit(False))
    met = met.withColumn("held", held)
    lasting = F.col("error").rlike("(?i)" + "|".join(x.replace(".", r"\.") for x in PERMANENT))
    ends = met.where(~F.col("held") & F.col("path").isNotNull() & lasting).groupBy(*group).agg(F.min("ord").alias("end_"))
    met = met.join(ends, [*group], "left") if group else met.withColumn("end_", F.lit(ends.first()["end_"]).cast(dict(rows.dtypes)["ord"]))
    behind = F.coalesce(F.col("ord") > F.col("end_"), F.lit(False))
    off = F.col("spec_page").isNotNull() & F.col("got_page").isNotNull() & (F.col("spec_page") != F.col("got_page"))
    status = F.when(behind, "STOPPED").when(F.col("held"), "HOLDOUT").when(F.col("path").isNull(), "NO_FILE").when(F.col("error").isNotNull(), "FAILED").when(off, "WRONG_PAGE").otherwise("SCORED")
    told = met.where(~(behind & F.col("held"))).withColumn("status", status)
    reason = (
        F.when(F.col("status") == "STOPPED", "stopped: a permanent error came before")
        .when(F.col("status") == "FAILED", F.concat(F.lit("failed: "), "error"))
        .when(F.col("status") == "WRONG_PAGE", F.concat(F.lit("wrong page (true "), F.col("spec_page").cast("string"), F.lit(", read "), F.col("got_page").cast("string"), F.lit(")")))
    )
    reason = reason.when(F.col("status") == "HOLDOUT", "held out").when(F.col("status") == "NO_FILE", "no file")
    return told.withColumn("reason", reason).select(*rows.columns, "status", "reason")


def score(gold: DataFrame, values: DataFrame, *, absent: DataFrame | None = None, holdout: DataFrame | None = None) -> DataFrame:
    """Gold cells (doc_id, field_key, truth, page, numeric) with got, raw, verdict and strict.

    Documents of ``holdout`` are left out. A page other than the true one makes
    the cell WRONG_PAGE unless it is MISSING or exact by page. Cells of fields
    that a class of equipment lacks (``absent``: cls, field_key) go if their
    truth is none; gold needs cls then.
    """
    if holdout is not None:
        gold = gold.join(holdout.select("doc_id"), "doc_id", "left_anti")
    if absent is not None:
        lacking = F.broadcast(absent.select("cls", "field_key", F.lit(True).alias("lacks")))
        gold = gold.join(lacking, ["cls", "field_key"], "left").where(~(F.coalesce("lacks", F.lit(False)) & is_na(clean(F.col("truth"))))).drop("lacks")
    met = gold.join(values.select("doc_id", "field_key", "got", "raw", F.col("page").alias("got_page")), ["doc_id", "field_key"], "left")
    off = F.col("page").isNotNull() & F.col("got_page").isNotNull() & (F.col("page") != F.col("got_page"))
    met, (truth, got, raw) = with_forms(met, "truth", "got", "raw")
    verdict = F.when(off, "WRONG_PAGE").otherwise(_judge(truth, got, raw, F.col("got").isNull(), F.col("numeric")))
    return without_forms(met.withColumn("verdict", verdict).withColumn("strict", (F.col("verdict") == "EXACT") & (truth.text == got.text)))


def _share(part: Column, whole: Column) -> Column:
    return F.bround(100 * F.try_divide(part, whole), 0)


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """cells, lenient, value_only and strict accuracy in percent (half to even)."""
    exact, valued = F.col("verdict") == "EXACT", ~is_na(clean(F.col("truth")))
    return scored.groupBy(*by).agg(
        F.count("*").alias("cells"),
        _share(F.count_if(exact), F.count("*")).alias("lenient"),
        _share(F.count_if(exact & valued), F.count_if(valued)).alias("value_only"),
        _share(F.count_if("strict"), F.count("*")).alias("strict"),
        F.count_if(exact & ~valued).alias("none_matched"),
    )


def accuracy_by_axes(scored: DataFrame, axes: list[str]) -> DataFrame:
    """Exact cells for each value of each axis and in all, in one pass of grouping sets."""
    sets = [[F.col(a)] for a in axes] + [[]]
    grouped = scored.groupingSets(sets, *[F.col(a) for a in axes])
    return grouped.agg(F.grouping_id().alias("grouping"), F.count("*").alias("cells"), F.count_if(F.col("verdict") == "EXACT").alias("exact"))


def verdict_counts(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS])


def weak_fields(scored: DataFrame, k: int = 12) -> DataFrame:
    """The k fields of lowest accuracy and their most common failure, the worse verdict of equally common ones."""
    counts = scored.groupBy("field_key", "verdict").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    bad = F.col("verdict") != "EXACT"
    per = counts.groupBy("field_key").agg(F.sum("n").alias("cells"), F.sum(F.when(~bad, F.col("n")).otherwise(0)).alias("exact"), F.max_by(F.when(bad, F.col("verdict")), F.when(bad, F.struct("n", -rank))).alias("failure"))
    return per.withColumn("accuracy", F.col("exact") / F.col("cells")).orderBy("accuracy", "field_key").limit(k)


def flag_quality(flags: DataFrame, scored: DataFrame) -> DataFrame:
    """How well flags (doc_id, field_key, source) find dangerous cells: one row for each source and one for all."""
    raised = flags.groupBy("doc_id", "field_key").agg(F.collect_set("source").alias("sources"))
    cells = scored.select("doc_id", "field_key", F.col("verdict").isin(*DANGEROUS).alias("bad")).join(raised, ["doc_id", "field_key"], "left")
    # a null source stands for all scored cells, flagged or not
    every = F.concat(F.when(F.col("sources").isNull(), F.array().cast("array<string>")).otherwise(F.array_union("sources", F.array(F.lit("ALL")))), F.array(F.lit(None).cast("string")))
    hits = cells.select("bad", F.explode(every).alias("source")).groupBy("source").agg(F.count("*").alias("flagged"), F.count_if("bad").alias("hits"))
    # a row for each source from here on
    total = F.max(F.when(F.col("source").isNull(), F.col("hits"))).over(Window.partitionBy(F.lit(1)))
    told = hits.withColumn("bad", total).where(F.col("source").isNotNull())
    return told.select("source", "flagged", "hits", "bad", F.try_divide("hits", "flagged").alias("precision"), F.try_divide("hits", "bad").alias("recall"))


def missed_by_field(flags: DataFrame, scored: DataFrame) -> DataFrame:
    """(field_key, dangerous, missed): dangerous cells of each field and those that no flag of any source names."""
    raised = flags.select("doc_id", "field_key", F.lit(True).alias("flagged")).distinct()
    met = scored.where(F.col("verdict").isin(*DANGEROUS)).join(raised, ["doc_id", "field_key"], "left")
    return met.groupBy("field_key").agg(F.count("*").alias("dangerous"), F.count_if(F.col("flagged").isNull()).alias("missed"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, n) of the cells that two runs scored."""
    met = before.select("doc_id", "field_key", F.col("verdict").alias("before")).join(after.select("doc_id", "field_key", F.col("verdict").alias("after")), ["doc_id", "field_key"])
    return met.groupBy("before", "after").agg(F.count("*").alias("n"))


def net_by_field(before: DataFrame, after: DataFrame) -> DataFrame:
    """Improved and worsened cells of each field and the share of the three largest nets."""
    place = lambda c: F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col(c))
    met = before.select("doc_id", "field_key", F.col("verdict").alias("b")).join(after.select("doc_id", "field_key", F.col("verdict").alias("a")), ["doc_id", "field_key"])
    per = met.groupBy("field_key").agg(F.count_if(place("a") > place("b")).alias("better"), F.count_if(place("a") < place("b")).alias("worse")).withColumn("net", F.col("better") - F.col("worse"))
    # one row a field: few enough to rank in one place
    order = Window.orderBy(F.abs("net").desc(), "field_key")
    top = F.sum(F.when(F.col("rank") <= 3, F.abs("net")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    return per.withColumn("rank", F.row_number().over(order)).withColumn("top3_share", F.try_divide(top, F.sum(F.abs("net")).over(Window.partitionBy(F.lit(1)))))


def stability(runs: DataFrame) -> DataFrame:
    """Of the cells that all repetitions (doc_id, field_key, rep, ok) hold: always right, never right, changing."""
    reps = runs.agg(F.count_distinct("rep").alias("reps"))
    cells = runs.groupBy("doc_id", "field_key").agg(F.count_distinct("rep").alias("n"), F.bool_and("ok").alias("every"), F.bool_or("ok").alias("some"))
    full = cells.join(F.broadcast(reps), F.col("n") == F.col("reps"))
    return full.agg(F.count_if("every").alias("always"), F.count_if(~F.col("some")).alias("never"), F.count_if(F.col("some") & ~F.col("every")).alias("flip"))


def sign_test(runs: DataFrame) -> DataFrame:
    """Pairs of variants (doc_id, field_key, rep, variant int, ok): cells only one has right, z and the decision."""
    # the variants of a cell are few: they meet in one group, not in a join of the rows with themselves
    cells = runs.groupBy("doc_id", "field_key", "rep").agg(F.collect_list(F.struct("variant", "ok")).alias("tried"))
    pairs = F.flatten(F.transform("tried", lambda a: F.transform(F.filter("tried", lambda b: b["variant"] > a["variant"]), lambda b: F.struct(a["variant"].alias("first"), b["variant"].alias("second"), a["ok"].alias("a"), b["ok"].alias("b")))))
    counted = cells.select(F.inline(pairs)).groupBy("first", "second").agg(F.count_if(F.col("a") & ~F.col("b")).alias("first_only"), F.count_if(~F.col("a") & F.col("b")).alias("second_only"))
    n = F.col("first_only") + F.col("second_only")
    z = F.try_divide(F.abs(F.col("first_only") - F.col("second_only")).cast("double"), F.sqrt(n))
    return counted.withColumn("z", z).withColumn("decision", F.when(n < 10, "hold").when(F.col("z") >= 2.58, "strong").when(F.col("z") >= 1.96, "win").otherwise("even"))


def escalation_effect(moved: DataFrame) -> DataFrame:
    """Of escalated cells (before, after verdicts): better, worse, same and net."""
    place = lambda c: F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col(c))
    sign = F.signum((place("after") - place("before")).cast("double"))
    return moved.agg(F.count_if(sign > 0).alias("better"), F.count_if(sign < 0).alias("worse"), F.count_if(sign == 0).alias("same"), F.sum(sign).cast("long").alias("net"))


def _reason(skipped: DataFrame) -> DataFrame:
    return skipped.select(F.trim(F.substring_index(F.substring_index("reason", ":", 1), "(", 1)).alias("reason"), "doc_id")


def unscored_reasons(skipped: DataFrame) -> DataFrame:
    """Documents by the reason's text before ':' and '(': their number and the smallest id; ``unscored_documents`` lists them."""
    return _reason(skipped).groupBy("reason").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def unscored_documents(skipped: DataFrame) -> DataFrame:
    """A row (reason, docs, doc_id) for each document, with the number of documents of its reason; none are gathered in one value."""
    rows = _reason(skipped)
    counts = rows.groupBy(F.col("reason").alias("of")).agg(F.count("*").alias("docs"))
    return rows.join(counts, F.col("reason").eqNullSafe(F.col("of"))).select("reason", "docs", "doc_id")


def quota_sample(files: DataFrame, quotas: DataFrame) -> DataFrame:
    """The first files of each format by the sha256 of their names, as many as the format's quota."""
    most = quotas.agg(F.max("quota")).first()[0] or 0  # a literal lets Spark cut each format before the shuffle
    order = Window.partitionBy("fmt").orderBy(F.sha2("file", 256), "file")
    ranked = files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(quotas), "fmt").where(F.col("rank") <= F.col("quota"))


def plausibility(sizes: DataFrame, warn: float = 35, suspect: float = 60) -> DataFrame:
    """Flow coefficients (cv, inches) by cv / inches^2."""
    ratio = F.try_divide(F.col("cv"), F.col("inches") * F.col("inches"))
    return sizes.withColumn("ratio", ratio).withColumn("check", F.when(F.col("ratio") > suspect, "suspect").when(F.col("ratio") > warn, "warn").when(F.col("ratio").isNotNull(), "normal"))
