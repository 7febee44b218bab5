"""From extractions to records: complete, normalise, validate, decide, derive.

A record is a row keyed by doc_id and field_key. Each stage adds columns; the
rule tables are broadcast, so that a run shuffles only where fields of one
document meet.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.tags import parse_tag, tag_kind
from docsift.functions.text import EMPTY_VALUES, found, join_notes, norm_alias, norm_label, norm_number, strip
from docsift.rules import RuleSet
from docsift.sources.tables import stored


def complete(extractions: DataFrame, docs: DataFrame, fields: DataFrame) -> DataFrame:
    """A row for each document and field: fields that were not extracted have a null value and a note."""
    # the field's other columns are joined afterwards, so that they are neither shuffled nor sorted
    wanted = docs.select("doc_id").distinct().join(F.broadcast(fields.select("field_key").distinct()), how="cross")
    met = wanted.join(extractions, ["doc_id", "field_key"], "left").join(F.broadcast(fields), "field_key")
    met = met.select("doc_id", *fields.columns, *[c for c in extractions.columns if c not in ("doc_id", "field_key")])
    return met.withColumn("note", F.coalesce("note", F.when(F.col("raw_value").isNull(), "NOT_EXTRACTED")))


def normalise(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds value and trace (array of steps) to rows (field_key, raw_value, raw_label, punctuation).

    In turn: the field's domain map (equal or a prefix), its direct map if the
    label says FAIL and not also the air's direction, an alias that isn't for
    comparison only, a leading zero. A value that wasn't found is null.
    """
    spark = rows.sparkSession
    raw = strip("raw_value")
    probe, got = norm_label(raw), norm_label(F.coalesce("raw_label", F.lit("")))
    direct = got.contains("FAIL") & ~got.rlike(r"AIRTO|ATO\b|ATC\b")
    # the few rules of a field fold into one array, so that a row meets one row and none is copied
    domain = rules.domain(spark).select("field_key", F.struct("ord", "kind", "to", norm_label(F.col("raw")).alias("norm")).alias("d"))
    domain = F.broadcast(domain.groupBy("field_key").agg(F.array_sort(F.collect_list("d")).alias("domain")))
    flags = rules.fields(spark).select("field_key", F.col("punctuation").alias("flag"))
    aliases = rules.aliases(spark).where("not compare_only").join(flags, "field_key", "left")
    aliases = aliases.select("field_key", norm_alias(F.col("raw"), F.coalesce("flag", F.lit(False))).alias("alias_norm"), "to", "ord")
    aliases = F.broadcast(aliases.groupBy("field_key", "alias_norm").agg(F.min_by("to", "ord").alias("alias_to")))
    met = rows.join(domain, "field_key", "left").withColumns({"probe_": probe, "direct_": direct, "alias_norm": norm_alias(raw, F.coalesce("punctuation", F.lit(False)))})
    met = met.join(aliases, ["field_key", "alias_norm"], "left")
    mapped = F.try_element_at(F.filter("domain", lambda d: (d["kind"] == "map") & F.col("probe_").startswith(d["norm"])), F.lit(1))["to"]
    straight = F.when(F.col("direct_"), F.try_element_at(F.filter("domain", lambda d: (d["kind"] == "direct_map") & (F.col("probe_") == d["norm"])), F.lit(1))["to"])
    fixed = norm_number(raw)
    told = found("raw_value")
    how = F.when(~told, "NONE").when(mapped.isNotNull(), "DOMAIN").when(straight.isNotNull(), "DIRECT").when(F.col("alias_to").isNotNull(), "ALIAS").when(fixed != raw, "NUMBER").otherwise("RAW")
    value = F.when(told, F.coalesce(mapped, straight, F.col("alias_to"), fixed))
    met = met.withColumns({"value": value, "how": how, "raw_": raw})
    # from columns that are there: the array's lambda would work each of them out again
    how, missed = F.col("how"), F.col("domain").isNotNull() & ~F.col("how").isin("DOMAIN", "DIRECT")
    steps = F.array(F.concat(F.lit("raw "), F.col("raw_")), F.when(missed, "no domain rule"), how, F.concat(F.lit("value "), F.col("value")))
    trace = F.when(how != "NONE", F.array_compact(steps)).otherwise(F.array().cast("array<string>"))
    return met.withColumn("trace", trace).drop("domain", "probe_", "direct_", "alias_norm", "alias_to", "raw_")


def is_empty(c: Column | str) -> Column:
    text = strip(c)
    # upper case never shortens a text, so that a longer one needs none
    return F.coalesce((F.length(text) <= max(map(len, EMPTY_VALUES))) & F.upper(text).isin(*EMPTY_VALUES), F.lit(True))


def format_violations(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds violations (array, in rule order) to rows (field_key, value, required): required, numeric, tag, pattern, max_length."""
    formats = F.broadcast(rules.formats(rows.sparkSession))
    text = strip("value")
    # each field's pattern is a literal, so it is compiled once
    patterns = {k: r["pattern"] for k, r in (rules.rules.get("format_rules") or {}).items() if r.get("pattern")}
    misfits = reduce(or_, [(F.col("field_key") == k) & ~text.rlike(f"^(?:{p})$") for k, p in patterns.items()], F.lit(False))
    # most fields have no rule: null & x would still work out x, a tag's parts, on every value
    asked = lambda c: F.coalesce(c, F.lit(False))
    told = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    # joined arrays, as the lambda of an array without nulls would be interpreted
    broken = F.concat(
        told(asked("need_number") & (~text.rlike(r"\d") | text.rlike("[가-힣]")), "numeric"),
        told(asked("need_tag") & parse_tag(text).isNull(), "tag"),
        told(misfits, "pattern"),
        told(F.col("max_length") < F.length(text), "max_length"),
    )
    missing = F.when(F.col("required"), F.array(F.lit("required"))).otherwise(F.array().cast("array<string>"))
    met = rows.join(formats, "field_key", "left")
    return met.withColumn("violations", F.when(is_empty("value"), missing).otherwise(broken)).drop("need_number", "need_tag", "pattern", "max_length")


def unknown_fields(rows: DataFrame, fields: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(fields.select("field_key")), "field_key", "left_anti")


def fail_parity(raw: Column, value: Column) -> Column:
    """False where a fail action contradicts its notation: with FAIL in the raw text both must agree, without it they must differ.

    True where nothing can be said.
    """
    a, b = norm_label(raw), norm_label(value)
    opens, closes, out_open, out_close = a.contains("OPEN"), a.contains("CLOSE"), b.contains("OPEN"), b.contains("CLOSE")
    clear = (opens != closes) & (out_open != out_close)
    alike = (opens & out_open) | (closes & out_close)
    return F.coalesce(~clear | (a.contains("FAIL") == alike), F.lit(True))


def failure(rows: DataFrame, safety_field: str = "fail_action") -> DataFrame:
    """Adds failure: NO_EVIDENCE, EXTRACTION, FORMAT, CONSTRAINT or NONE; format comes before domain."""
    empty = F.coalesce(strip("value") == "", F.lit(True))
    kind = F.when(empty & ~found("raw_value"), "NO_EVIDENCE").when(empty, "EXTRACTION").when(F.size("violations") > 0, "FORMAT")
    kind = kind.when((F.col("field_key") == safety_field) & ~fail_parity(F.col("raw_value"), F.col("value")), "CONSTRAINT")
    return rows.withColumn("failure", kind.otherwise("NONE"))


def decide(rows: DataFrame, *, agent: Column | None = None) -> DataFrame:
    """Adds state auto, review or na from failure, confidence, threshold and an agent's answer (null: not asked)."""
    asked = F.lit(None).cast("boolean") if agent is None else agent
    sure = F.col("confidence") >= F.col("threshold")
    state = (
        F.when(F.col("failure") == "NO_EVIDENCE", "na")
        .when(F.col("failure") != "NONE", "review")
        .when(~sure & ~asked, "review")
        .when(~sure & asked, "auto")
        .when(F.coalesce(~sure, F.lit(True)), "review")
        .otherwise("auto")
    )
    doubt = F.when((F.col("failure") == "NONE") & ~sure, F.format_string("confidence %.2f < %.2f", "confidence", "threshold"))
    out = rows.withColumn("state", state).withColumn("value", F.when(F.col("state") != "na", F.col("value")))
    return out.withColumn("note", join_notes(F.when(F.col("failure") != "NONE", F.lower("failure")), F.array_join("violations", " · "), doubt, F.col("note")))


def derive(records: DataFrame, rules: RuleSet) -> DataFrame:
    """Fills derived fields without evidence from another field of the same document; such values have confidence 0 and need review."""
    derived = F.broadcast(rules.derived(records.sparkSession))
    sources = derived.select(F.col("source_key").alias("field_key")).distinct()
    known = records.join(F.broadcast(sources), "field_key", "left_semi").select("doc_id", F.col("field_key").alias("source_key"), tag_kind(F.col("value")).alias("kind"))
    made = known.join(derived, ["source_key", "kind"]).select("doc_id", "field_key", F.col("value").alias("made"))
    made = made.groupBy("doc_id", "field_key").agg(F.min("made").alias("made"))
    met = records.join(made, ["doc_id", "field_key"], "left")
    use = (F.col("failure") == "NO_EVIDENCE") & F.col("made").isNotNull()
    return met.withColumns({"value": F.when(use, F.col("made")).otherwise(F.col("value")), "state": F.when(use, "review").otherwise(F.col("state")), "confidence": F.when(use, 0.0).otherwise(F.col("confidence"))}).drop("made")


def resolve(extractions: DataFrame, docs: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """The whole chain from extractions (doc_id, field_key, raw_value, raw_label, confidence, note) to records."""
    rules = rules or RuleSet()
    rows = complete(extractions, docs, rules.fields(docs.sparkSession))
    rows = failure(format_violations(normalise(rows, rules), rules))
    return derive(decide(rows), rules)


def state_counts(records: DataFrame) -> DataFrame:
    """Per document the number of records in each state, zeros included, and whether it can be approved."""
    safe = (F.col("state") == "auto") & (F.col("safety") == "normal")
    return records.groupBy("doc_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("auto", "review", "na")], F.coalesce(F.bool_and(F.when(F.col("required"), safe)), F.lit(True)).alias("approvable"))


def run_summary(counts: DataFrame) -> DataFrame:
    total = F.sum(F.col("auto") + F.col("review") + F.col("na"))
    return counts.agg(F.count("*").alias("docs"), F.sum("auto").alias("auto"), F.sum("review").alias("review"), F.sum("na").alias("na"), F.bround(F.sum("auto") / F.greatest(total, F.lit(1)), 4).alias("auto_rate"), F.count_if("approvable").alias("approvable"))


def apply_actions(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Human actions (doc_id, field_key, seq, action, human_value): the last one counts; adds action, final_value and resolved."""
    last = actions.groupBy("doc_id", "field_key").agg(F.max_by(F.struct("action", "human_value"), "seq").alias("a"))
    met = records.join(last, ["doc_id", "field_key"], "left")
    undone = F.nullif(F.col("a.action"), F.lit("undo"))
    human = F.when(undone == "override", F.col("a.human_value"))
    return met.select(*records.columns, undone.alias("action"), F.coalesce(human, F.col("value")).alias("final_value"), (((F.col("state") == "auto") & (F.col("safety") == "normal")) | undone.isNotNull()).alias("resolved"))


def bulk_approve(records: DataFrame, actions: DataFrame) -> DataFrame:
    """New actions that approve the automatic records of normal fields on which nobody has acted; safety and identity fields need a look."""
    acted = actions.groupBy("doc_id", "field_key").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    met = records.where("state = 'auto' and safety = 'normal'").join(acted, ["doc_id", "field_key"], "left").where(F.col("action").isNull() | (F.col("action") == "undo"))
    return met.select("doc_id", "field_key", (F.coalesce("seq", F.lit(0)) + 1).alias("seq"), F.lit("approve").alias("action"), F.lit(None).cast("string").alias("human_value"))


def on_pages(extractions: DataFrame, picks: DataFrame) -> DataFrame:
    """Extractions from the pages chosen (doc_id, page); a document for which none was chosen keeps all of its pages."""
    chosen = picks.where("page is not null").groupBy("doc_id").agg(F.collect_set("page").alias("pages_"))
    met = extractions.join(chosen, "doc_id", "left")
    return met.where(F.col("pages_").isNull() | F.array_contains("pages_", F.col("page"))).drop("pages_")


def retry(records: DataFrame, second: DataFrame, rules: RuleSet) -> DataFrame:
    """Records with EXTRACTION failures resolved anew from a second reading (doc_id, field_key, raw_value, raw_label, confidence).

    Adds retry_count and retry_changed; other failures are for people and are
    not read again, nor is anything where the second reading found nothing.
    """
    again = second.select("doc_id", "field_key", *[F.col(c).alias(f"{c}_2") for c in ("raw_value", "raw_label", "confidence")])
    met = records.join(again, ["doc_id", "field_key"], "left")
    use = (F.col("failure") == "EXTRACTION") & found(F.col("raw_value_2"))
    met = met.withColumns({"retry_count": F.when(use, 1).otherwise(0), "retry_changed": use & ~F.col("raw_value").eqNullSafe(F.col("raw_value_2"))})
    kept = met.where("retry_count = 0").drop("raw_value_2", "raw_label_2", "confidence_2")
    inputs = met.where("retry_count = 1").withColumns({c: F.col(f"{c}_2") for c in ("raw_value", "raw_label", "confidence")}).drop("raw_value_2", "raw_label_2", "confidence_2", "value", "how", "trace", "violations", "failure", "state")
    redone = decide(failure(format_violations(normalise(inputs, rules), rules)))
    return kept.unionByName(redone.select(*kept.columns))


def contract(records: DataFrame) -> DataFrame:
    """Adds contract, what a record breaks: NO_NOTE (not automatic, yet without a reason) or NA_WITH_VALUE; null if nothing.

    What is broken is told in the note, and so is that an automatic value of a
    safety or identity field needs a look.
    """
    blank = F.coalesce(strip(F.col("note")) == "", F.lit(True))
    broken = F.when((F.col("state") != "auto") & blank, "NO_NOTE").when((F.col("state") == "na") & ~is_empty(F.col("value")), "NA_WITH_VALUE")
    look = F.when((F.col("state") == "auto") & (F.col("safety") != "normal"), "a person must look: safety or identity")
    out = records.withColumn("contract", broken)
    return out.withColumn("note", join_notes(F.col("note"), look, F.concat(F.lit("broken contract "), "contract")))


def escalations(records: DataFrame) -> DataFrame:
    """(doc_id, field_key, reason) of all records that aren't automatic; a blank reason stays blank, to be counted."""
    return records.where("state <> 'auto'").select("doc_id", "field_key", F.coalesce(strip(F.col("note")), F.lit("")).alias("reason"))


def reread(records: DataFrame, rules: RuleSet, reader, *, rounds: int = 2) -> DataFrame:
    """Records with EXTRACTION failures read again, up to so many rounds or until none is left, and all checked by ``contract``.

    ``reader(requests, round)`` takes rows (doc_id, field_key, raw_value) and
    gives rows (doc_id, field_key, raw_value, raw_label, confidence). A field
    it leaves out is settled as it is, with a note. Each round resolves the
    failing rows alone; they are stored, so that a later round or a lost
    executor doesn't ask the reader again. Adds retry_count, retry_changed and
    retry_values (what stood before and what was read, of the last round).
    """
    failing = F.col("failure") == "EXTRACTION"
    none = F.array().cast("array<string>")
    marked = records.withColumns({"retry_count": F.lit(0), "retry_changed": F.lit(False), "retry_values": none})
    done, columns = [marked.where(F.coalesce(~failing, F.lit(True)))], marked.columns
    left = stored(marked.where(failing), "failing")
    for k in range(1, rounds + 1):
        if left.isEmpty():
            break
        fresh = reader(left.select("doc_id", "field_key", "raw_value"), k).select("doc_id", "field_key", F.lit(True).alias("read_"), *[F.col(c).alias(f"{c}_2") for c in ("raw_value", "raw_label", "confidence")])
        met = stored(left.join(fresh, ["doc_id", "field_key"], "left"), f"read-{k}")
        done.append(met.where("read_ is null").withColumns({"retry_count": F.lit(k), "note": join_notes(F.col("note"), F.lit("can't be read again"))}).select(*columns))
        same = F.col("raw_value").eqNullSafe(F.col("raw_value_2"))
        told = met.where("read_").withColumns({"retry_count": F.lit(k), "retry_changed": ~same, "retry_values": F.array("raw_value", "raw_value_2")})
        told = told.withColumns({c: F.col(f"{c}_2") for c in ("raw_value", "raw_label", "confidence")}).withColumn("note", F.lit(None).cast("string"))
        inputs = told.drop("read_", "raw_value_2", "raw_label_2", "confidence_2", "value", "how", "trace", "violations", "failure", "state")
        redone = stored(decide(failure(format_violations(normalise(inputs, rules), rules))).select(*columns), f"round-{k}")
        done.append(redone.where(~failing))
        left = redone.where(failing)
    return contract(reduce(DataFrame.unionByName, [*done, left]))


def replay(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored extractions of the documents asked for; one without any has an error row."""
    met = docs.select("doc_id").distinct().join(stored, "doc_id", "left")
    return met.withColumn("error", F.when(F.col("field_key").isNull(), "NOT_STORED"))


def cached_or_read(requests: DataFrame, cache: DataFrame, reader) -> DataFrame:
    """Answers (key, payload) from the cache, and by ``reader(DataFrame) -> DataFrame`` for the keys that miss."""
    hits = requests.join(cache, "key").select("key", "payload")
    return hits.unionByName(reader(requests.join(cache, "key", "left_anti")).select("key", "payload"))
