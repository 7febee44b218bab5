"""Reports over gold values: scorers of single readers, runs of a grid, costs, checks of the gold itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.tags import parse_filename, parse_tag
from docsift.functions.text import same_forms, strip, with_forms, without_forms
from docsift.operators.crosscheck import with_standard
from docsift.operators.gold import REGULATOR

#: Gold cells with these values are not scored.
SKIPPED = ("N/A", "NA", "판독불가", "")
READER_VERDICTS = ("EXACT", "NOTATION", "PENDING_NORM", "WRONG", "MISSING")
#: Verdicts that count as right when readers are compared.
RIGHT = READER_VERDICTS[:3]


def cell_text(value: Column, is_string: Column) -> Column:
    """A cell as it was written: a number that a workbook stores as 195.0 is 195. Null gives ''."""
    whole = F.regexp_replace(value, r"^(-?\d+)\.0+$", "$1")
    return strip(F.coalesce(F.when(is_string, value).otherwise(whole), F.lit("")))


def gold_text(value: Column, is_string: Column) -> Column:
    """A gold cell without its leading question mark; null where it isn't to be scored."""
    text = strip(F.regexp_replace(cell_text(value, is_string), r"^\?", ""))
    return F.when(~_level(text).isin(*SKIPPED), text)


def _level(c: Column) -> Column:
    """One space between words, upper case."""
    return F.upper(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def _loose(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9A-Z]", "")


def holds(a: Column, b: Column) -> Column:
    """Either of two loose forms holds the other and none is empty."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _readable(rows: DataFrame, *names: str) -> DataFrame:
    """Adds <name>_level and <name>_loose, so that each is made once a row."""
    return rows.withColumns({f"{n}_level": _level(F.col(n)) for n in names} | {f"{n}_loose": _loose(F.col(n)) for n in names})


def score_text(gold: DataFrame, values: DataFrame, aliases: DataFrame) -> DataFrame:
    """Gold cells (doc_id, field_key, labeler, truth, is_string, numeric) with the text reader's verdict and rule state.

    ``values`` has doc_id, field_key, got and normalised (what the rules make
    of it). NOTATION differs in spelling or units only, PENDING_NORM after the
    aliases (those for comparison included) or as a part of the other. The rule
    state is RESOLVED or GAP where the rules lead, or don't, from a value that
    is PENDING_NORM or WRONG to the truth, and '' elsewhere.
    """
    cells = gold.withColumns({"uncertain": strip(F.coalesce("truth", F.lit(""))).startswith("?"), "truth": gold_text(F.col("truth"), F.col("is_string"))}).where("truth is not null")
    met = cells.join(values.select("doc_id", "field_key", "got", "normalised"), ["doc_id", "field_key"], "left")
    met = with_standard(with_standard(met, "truth", aliases), "got", aliases)
    met = _readable(met, "truth", "got", "normalised")
    met, (truth, got, made, truth_std, got_std) = with_forms(met, "truth", "got", "normalised", "truth_std", "got_std")
    numeric, loose = F.col("numeric"), F.col("got_loose")
    verdict = (
        F.when(F.col("got").isNull(), "MISSING")
        .when(F.col("got_level") == F.col("truth_level"), "EXACT")
        .when((loose == F.col("truth_loose")) | same_forms(truth, got, numeric), "NOTATION")
        .when(same_forms(truth_std, got_std, numeric) | holds(loose, F.col("truth_loose")), "PENDING_NORM")
        .otherwise("WRONG")
    )
    led = (F.coalesce("normalised", F.lit("")) != "") & ((F.col("normalised_level") == F.col("truth_level")) | (F.col("normalised_loose") == F.col("truth_loose")) | same_forms(truth, made, numeric))
    met = met.withColumn("verdict", verdict)
    state = F.when(F.col("verdict").isin("PENDING_NORM", "WRONG"), F.when(led, "RESOLVED").otherwise("GAP")).otherwise("")
    return without_forms(met.withColumn("rule_state", state)).select("doc_id", "field_key", "labeler", "truth", "uncertain", "got", "verdict", "rule_state")


def labeler_counts(scored: DataFrame, machines: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts and rule states by labeler, with a row HUMAN for all who aren't in ``machines``."""
    kinds = {v.lower(): F.count_if(F.col("verdict") == v) for v in READER_VERDICTS} | {s.lower(): F.count_if(F.col("rule_state") == s) for s in ("RESOLVED", "GAP")}
    each = scored.groupBy(F.coalesce("labeler", F.lit("UNKNOWN")).alias("labeler")).agg(F.count("*").alias("cells"), *[c.alias(n) for n, c in kinds.items()])
    # a row for each labeler from here on
    human = ~F.col("labeler").isin(*machines) if machines else F.lit(True)
    both = F.when(human, F.array("labeler", F.lit("HUMAN"))).otherwise(F.array("labeler"))
    names = ["cells", *kinds]
    return each.select(F.explode(both).alias("labeler"), *names).groupBy("labeler").agg(*[F.sum(n).alias(n) for n in names])


def score_grid(gold: DataFrame, asked: DataFrame, answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Verdicts of each combination (model, size, rep) on the gold cells of the documents it answered.

    ``gold`` has doc_id, field_key, truth, is_string; ``asked`` doc_id, model,
    size, rep of the readings that didn't fail; ``answers`` also field_key and
    value. A field without an answer is MISSING.
    """
    grid = ["model", "size", "rep"]
    cells = gold.withColumn("truth", gold_text(F.col("truth"), F.col("is_string"))).where("truth is not null")
    met = cells.join(asked.select("doc_id", *grid).distinct(), "doc_id").join(answers.select("doc_id", "field_key", *grid, F.nullif(strip(F.col("value")), F.lit("")).alias("got")), ["doc_id", "field_key", *grid], "left")
    met = _readable(with_standard(with_standard(met, "truth", aliases), "got", aliases), "truth", "got", "truth_std", "got_std")
    verdict = (
        F.when(F.col("got").isNull(), "MISSING")
        .when(F.col("got_level") == F.col("truth_level"), "EXACT")
        .when(F.col("got_loose") == F.col("truth_loose"), "NOTATION")
        .when((F.col("got_std_level") == F.col("truth_std_level")) | holds(F.col("got_loose"), F.col("truth_loose")), "PENDING_NORM")
        .otherwise("WRONG")
    )
    return met.select("doc_id", "field_key", *grid, "truth", "got", verdict.alias("verdict"))


def success(scored: DataFrame, *by: str) -> DataFrame:
    """Cells of each verdict and the share of right ones in percent."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in READER_VERDICTS]
    right = F.count_if(F.col("verdict").isin(*RIGHT))
    return scored.groupBy(*by).agg(F.count("*").alias("cells"), *counts, (100 * F.try_divide(right, F.count("*"))).alias("rate"))


def cost_by_model(calls: DataFrame) -> DataFrame:
    """Calls (model, tokens_in, tokens_out) summed by model."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def run_costs(calls: DataFrame) -> DataFrame:
    """Tokens of each run and its models, sorted and joined."""
    per = calls.groupBy("run_id", "model").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    return per.groupBy("run_id").agg(F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.array_join(F.array_sort(F.collect_set("model")), " · ").alias("models"))


def page_accuracy(calls: DataFrame, *by: str) -> DataFrame:
    """Documents (gold_page, page) whose specification page was chosen right, of those where both are known."""
    right = F.count_if(F.col("gold_page") == F.col("page"))
    known = calls.where("gold_page is not null and page is not null")
    return known.groupBy(*by).agg(F.count("*").alias("calls"), right.alias("correct"), F.bround(100 * F.try_divide(right, F.count("*")), 0).alias("rate"))


def page_audit(choices: DataFrame, picks: DataFrame) -> DataFrame:
    """People's pages (doc_id, page) against the rule's: MATCH, MISMATCH, or UNDECIDABLE where the rule picked none."""
    met = choices.select("doc_id", "page").join(picks.select("doc_id", F.col("page").alias("rule_page"), "rule"), "doc_id", "left")
    verdict = F.when(F.col("rule_page").isNull(), "UNDECIDABLE").when(F.col("rule_page") == F.col("page"), "MATCH").otherwise("MISMATCH")
    return met.withColumn("verdict", verdict)


def crosscheck_report(gold: DataFrame, records: DataFrame, checked: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each document: records that meet the gold or miss it, agreements and conflicts of the two readers, and the path.

    ``gold`` has doc_id, field_key, truth, is_string, numeric; ``records``
    doc_id, field_key, value, by_model; ``checked`` comes from ``crosscheck``.
    The path is COMPARED where both readers read a field, MODEL_ONLY where the
    model read it alone, else TEXT_ONLY.
    """
    truths = gold.withColumn("truth", gold_text(F.col("truth"), F.col("is_string"))).where("truth is not null")
    met = records.select("doc_id", "field_key", "value", "by_model").join(truths.select("doc_id", "field_key", "truth", "numeric"), ["doc_id", "field_key"], "left")
    met = with_standard(with_standard(met, "truth", aliases), "value", aliases)
    met, (truth, value, truth_std, value_std) = with_forms(met, "truth", "value", "truth_std", "value_std")
    both = F.col("truth").isNotNull() & F.col("value").isNotNull()
    same = same_forms(truth, value, F.col("numeric")) | same_forms(truth_std, value_std, F.col("numeric"))
    per = met.groupBy("doc_id").agg(F.count_if(both & same).alias("hit"), F.count_if(both & ~same).alias("miss"), F.bool_or("by_model").alias("by_model"))
    read = checked.groupBy("doc_id").agg(F.count_if(F.col("state").isin("AGREE", "NOTATION")).alias("agree"), F.count_if(F.col("state") == "CONFLICT").alias("conflict"))
    out = per.join(read, "doc_id", "left")
    # agreements count only where the model's path was taken
    n = {c: F.when(F.col("by_model"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long") for c in ("agree", "conflict")}
    path = F.when(n["agree"] + n["conflict"] > 0, "COMPARED").when(F.col("by_model"), "MODEL_ONLY").otherwise("TEXT_ONLY")
    return out.select("doc_id", "hit", "miss", *[c.alias(k) for k, c in n.items()], path.alias("path"))


def era_gap(before: DataFrame, after: DataFrame, split) -> DataFrame:
    """Exact cells of two runs for documents up to ``split`` (early) and after it: do the rules help documents they weren't made from?

    Sign: overfit where the early gain is larger by 2 points or more,
    generalises where the later one is, even otherwise or where an era is empty.
    """
    met = before.select("doc_id", "field_key", (F.col("verdict") == "EXACT").alias("b")).join(after.select("doc_id", "field_key", (F.col("verdict") == "EXACT").alias("a")), ["doc_id", "field_key"])
    era = F.when(F.col("doc_id") <= F.lit(split), "early").otherwise("later")
    out = met.groupBy(era.alias("era")).agg(F.count("*").alias("cells"), F.count_if("b").alias("before"), F.count_if("a").alias("after"))
    out = out.withColumn("gain", 100 * F.col("after") / F.col("cells") - 100 * F.col("before") / F.col("cells"))
    # two rows at most from here on
    both = out.agg(*[F.max(F.when(F.col("era") == e, F.col("gain"))).alias(e) for e in ("early", "later")])
    gap = F.col("later") - F.col("early")
    sign = F.when(gap <= -2, "overfit").when(gap >= 2, "generalises").otherwise("even")
    return out.crossJoin(F.broadcast(both.select(sign.alias("sign"))))


def plausible_range(checked: DataFrame) -> DataFrame:
    """Of normal flow coefficients (``evaluate.plausibility``): number, upper median and largest ratio."""
    normal = checked.where(F.col("check") == "normal")
    # from above, the discrete median of an even number is the upper one
    return normal.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ratio DESC)").alias("median"), F.max("ratio").alias("largest"))


def tag_conflicts(gold: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, file, truth) whose file name has another tag than the gold; without a tag on either side there is no conflict."""
    if holdout is not None:
        gold = gold.join(holdout.select("doc_id"), "doc_id", "left_anti")
    told = gold.select("doc_id", parse_filename(F.col("file"))["tag"].alias("file_tag"), strip(F.coalesce("truth", F.lit(""))).alias("truth"))
    told = told.withColumn("gold_tag", parse_tag(F.col("truth"))["key"])
    return told.where((F.col("truth") != "") & F.col("file_tag").isNotNull() & ~F.col("file_tag").eqNullSafe(F.col("gold_tag"))).select("doc_id", "file_tag", "gold_tag")


def probe_documents(pages: DataFrame, vendors: list[tuple[str, str]], least: int = 100) -> DataFrame:
    """Pages, pages with text, vendor and regulator of documents (doc_id, page, text).

    The vendor is the first of the list whose pattern a page holds; it and the
    regulator are told only from ``least`` characters on. Pages are searched
    one by one, so no document is gathered.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.length(strip(text))
    order = F.coalesce(*[F.when(text.rlike(f"(?i){pattern}"), k) for k, (_, pattern) in enumerate(vendors)], F.lit(None).cast("int"))
    told = pages.select("doc_id", size.alias("size"), order.alias("vendor"), text.rlike(REGULATOR).alias("regulator"))
    enough = F.sum("size") >= least
    name = F.try_element_at(F.array(*[F.lit(n) for n, _ in vendors]).cast("array<string>"), (F.min("vendor") + 1).cast("int"))
    return told.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("size") >= least).alias("text_pages"), F.when(enough, F.coalesce(name, F.lit(""))).otherwise("").alias("vendor"), (enough & F.bool_or("regulator")).alias("regulator"))


def format_bucket(extension: Column) -> Column:
    """tif, pdf or xlsx by a lower-case extension; null for other formats."""
    return F.when(extension.isin("tif", "tiff"), "tif").when(extension == "pdf", "pdf").when(extension.isin("xlsx", "xlsm", "xls"), "xlsx")


def is_text_pdf(pages: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, is_text): the first three pages (doc_id, page, text) have ``least`` characters or more."""
    return pages.where("page <= 3").groupBy("doc_id").agg((F.sum(F.length(strip(F.coalesce("text", F.lit(""))))) >= least).alias("is_text"))


def schema_summary(fields: DataFrame) -> DataFrame:
    """Counts over field definitions (required, mvp, safety, aliases: number)."""
    count = {"required": F.col("required"), "mvp": F.col("mvp"), "safety": F.col("safety") == "safety", "identity": F.col("safety") == "identity", "with_aliases": F.col("aliases") > 0}
    return fields.agg(F.count("*").alias("field_count"), *[F.count_if(c).alias(n) for n, c in count.items()])
