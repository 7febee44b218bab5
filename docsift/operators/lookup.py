"""Label lookup, sections, composite labels and prefixes: joins with small broadcast dimensions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.text import ascii_label, bare_label, found, strip
from docsift.rules import RuleSet, plain_label


def lookup_labels(labels: DataFrame, index: DataFrame, key: str = "label_id") -> DataFrame:
    """(key, field_key, confidence, matched_on) of the labels that name one field.

    ``labels`` has the key column, label, section (null if unknown) and allowed
    (array of field keys, null if any). ``index`` is ``RuleSet.labels``. The
    exact label decides, else the label without parentheses. Entries of other
    sections go, own ones come first; within an allowed list the first wins;
    else the first wins if alone or a standard name, and nothing does otherwise.
    """
    full = ascii_label(F.col("label"))
    bare = ascii_label(bare_label(F.coalesce("label", F.lit(""))))
    entries = index.select(ascii_label(F.col("label")).alias("norm"), "field_key", F.col("section").alias("own_section"), "confidence", "matched_on", "ord")
    entries = entries.groupBy("norm", "field_key", "own_section").agg(F.min_by(F.struct("confidence", "matched_on", "ord"), "ord").alias("e")).select("norm", "field_key", "own_section", "e.*")
    entries = F.broadcast(entries)
    known = labels.select(key, "section", "allowed", full.alias("full"), bare.alias("bare"))
    hit = known.withColumn("norm", F.explode(F.array_distinct(F.array("full", "bare")))).join(entries, "norm")
    # only the exact label's entries count where there are any
    level = Window.partitionBy(key)
    hit = hit.withColumn("exact", F.max((F.col("norm") == F.col("full")).cast("int")).over(level)).where("exact = 0 or norm = full")
    hit = hit.where(F.when(F.col("section").isNull(), F.col("own_section").isNull()).otherwise(F.col("own_section").isNull() | (F.col("own_section") == F.col("section"))))
    hit = hit.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("field_key")))
    order = Window.partitionBy(key).orderBy(F.coalesce(F.col("own_section") == F.col("section"), F.lit(False)).desc(), "ord")
    ranked = hit.withColumns({"rank": F.row_number().over(order), "n": F.count("*").over(level)})
    first = ranked.where((F.col("rank") == 1) & (F.col("allowed").isNotNull() | (F.col("n") == 1) | (F.col("matched_on") == "name")))
    return first.select(key, "field_key", "confidence", "matched_on")


def label_rows(spark: SparkSession, rules: RuleSet) -> list[tuple]:
    """(norm, own, field_key, confidence): what each label of the rules names in each section; own is '' where no section is known.

    There are as many as labels times sections, whatever the data, so they are
    worked out once for a rule set and held.
    """
    if rules.label_rows is None:
        rules.label_rows = [tuple(r) for r in _label_rows(spark, rules).collect()]
    return rules.label_rows


def _label_rows(spark: SparkSession, rules: RuleSet) -> DataFrame:
    allowed = rules.section_allowed()
    sections = [(None, None), *((s, allowed.get(s)) for s in dict.fromkeys([*rules.section_names(), *allowed]))]
    options = F.array(*[F.struct(F.lit(s).cast("string").alias("section"), (F.lit(None) if a is None else F.array(*map(F.lit, a))).cast("array<string>").alias("allowed")) for s, a in sections])
    norms = rules.labels(spark).select(ascii_label(F.col("label")).alias("label")).where("label <> ''").distinct()
    labels = norms.select("label", F.inline(options)).withColumn("label_id", F.struct(F.col("label").alias("norm"), F.coalesce("section", F.lit("")).alias("own")))
    return labels.join(lookup_labels(labels, rules.labels(spark), "label_id"), "label_id", "left").select("label_id.*", "field_key", "confidence")


#: Levels of the halving of a page's positions; ranks stay below 2 to this power.
HALVINGS = 31


def _governed(points: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
    """(point_id, m): the mark, as struct (mark_col, before, section), that governs a point; null where none does.

    Work follows points and marks, not their pairs. Points of one place count
    once, and of marks with one range and column the first. A range of marks is
    cut into blocks of halved positions, at most two a level; a point looks in
    the block of each level that marks use. A block's marks hold all its
    positions, so that the last one before the point in order of columns is its
    best: one running maximum over each block.
    """
    places = points.where("pos is not null and col is not null").select(*group, "pos", "col").distinct()
    ranges = marks.where("lo <= hi").groupBy(*group, "lo", "hi", F.col("col").alias("mark_col")).agg(F.max(F.struct((-F.col("ord")).alias("before"), "section")).alias("m"))
    ranges = ranges.select(*group, "lo", "hi", F.struct("mark_col", "m.before", "m.section").alias("m"))
    # positions are ranked once; a bound's place among them is the number of positions before it
    edge = lambda rows, c, kind: rows.select(*group, F.col(c).alias("at"), F.lit(kind).alias("kind")).distinct()
    edges = edge(ranges, "lo", 0).union(edge(places, "pos", 1)).union(edge(ranges, "hi", 2))
    before = F.sum((F.col("kind") == 1).cast("long")).over(Window.partitionBy(*group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.withColumn("rank", before)
    ranked = lambda kind, c, name: edges.where(F.col("kind") == kind).select(*group, F.col("at").alias(c), F.col("rank").alias(name))
    ranges = ranges.join(ranked(0, "lo", "first"), [*group, "lo"]).join(ranked(2, "hi", "end"), [*group, "hi"]).where("first < end")
    places = places.join(ranked(1, "pos", "rank"), [*group, "pos"]).withColumn("rank", F.col("rank") - 1)

    size = F.pow(F.lit(2.0), "level").cast("long")
    cut = ranges.select(*group, "m", "first", "end", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("level"))
    cut = cut.select(*group, "m", "level", F.ceil(F.col("first") / size).alias("l"), F.floor(F.col("end") / size).alias("r")).where("l < r")
    odd = lambda c: F.col(c) % 2 == 1
    blocks = cut.select(*group, "level", "m", F.explode(F.array_compact(F.array(F.when(odd("l"), F.col("l")), F.when(odd("r"), F.col("r") - 1)))).alias("block"))
    key = [*group, "level", "block"]
    levels = blocks.groupBy(*group).agg(F.collect_set("level").alias("levels"))  # 32 at most
    asked = places.join(levels, group).select(*group, "pos", "col", "rank", F.explode("levels").alias("level")).withColumn("block", F.floor(F.col("rank") / size))
    asked = asked.join(blocks.select(*key).distinct(), key, "left_semi")
    # a mark of the point's own column doesn't stand to its left
    met = asked.select(*key, "pos", "col", F.lit(None).cast(dict(ranges.dtypes)["m"]).alias("m"), F.lit(0).alias("kind"))
    met = met.union(blocks.select(*key, F.lit(None).cast(dict(places.dtypes)["pos"]).alias("pos"), F.col("m.mark_col").alias("col"), "m", F.lit(1).alias("kind")))
    best = met.withColumn("m", F.max("m").over(Window.partitionBy(*key).orderBy("col", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    best = best.where("kind = 0 and m is not null").groupBy(*group, "pos", "col").agg(F.max("m").alias("m"))
    return points.select("point_id", *group, "pos", "col").join(best, [*group, "pos", "col"], "left").groupBy("point_id").agg(F.max("m").alias("m"))


def sections_at(points: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
    """``points`` (group, pos, col) with the section of the nearest mark to the left whose range holds pos.

    Of marks in one column the one of the smallest ord counts. Points without a
    mark keep a null section. ``points`` needs a point_id.
    """
    return _governed(points, marks, group).select("point_id", "m.section")


def bands_at(points: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
    """As ``sections_at``, with band: the column of the mark that governs the point. Points of one block share a band, not a section."""
    return _governed(points, marks, group).select("point_id", "m.section", F.col("m.mark_col").alias("band"))


def section_marks(cells: DataFrame, merges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Marks of a sheet: ranges merged over two rows or more whose text names a section.

    (doc_id, page, section, lo, hi, col, ord, row, anchor_col): the rows the
    range spans, its last column, and its first cell. Ranges within one row are
    titles, not sections. ``aliases`` has alias and section.
    """
    known = F.broadcast(aliases.select(ascii_label(F.col("alias")).alias("norm"), "section").groupBy("norm").agg(F.min("section").alias("section")))
    tall = merges.where("r1 > r0").withColumns({"row": F.col("r0"), "col": F.col("c0")})
    met = tall.join(cells.select("doc_id", "page", "row", "col", "value"), ["doc_id", "page", "row", "col"])
    met = met.withColumn("norm", ascii_label(F.col("value"))).join(known, "norm")
    return met.select("doc_id", "page", "section", F.col("r0").alias("lo"), F.col("r1").alias("hi"), F.col("c1").alias("col"), (F.col("r0") * 16384 + F.col("c0")).alias("ord"), "row", F.col("c0").alias("anchor_col"))


def without_marks(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """Cells that aren't the anchor of a section's mark, so that a mark is never read as a label."""
    anchors = marks.select("doc_id", "page", "row", F.col("anchor_col").alias("col"))
    return cells.join(anchors, ["doc_id", "page", "row", "col"], "left_anti")


def section_bands(marks: DataFrame, group: list[str]) -> DataFrame:
    """Marks (centre, height) get lo and hi: the midpoints to their neighbours, mirrored at the outer ends, a height off for one alone."""
    order = Window.partitionBy(*group).orderBy("centre")
    up, down = F.lag("centre").over(order), F.lead("centre").over(order)
    before, after = (F.col("centre") - up) / 2, (down - F.col("centre")) / 2
    return marks.withColumns({"lo": F.col("centre") - F.coalesce(before, after, "height"), "hi": F.col("centre") + F.coalesce(after, before, "height")})


def longest_prefix(models: DataFrame, prefixes: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, maker) by the longest prefix of the model; of equally long ones the first rule's."""
    norm = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    rules = F.broadcast(prefixes.select("kind", norm(F.col("prefix")).alias("prefix"), "to", "ord"))
    met = models.withColumn("norm", norm(F.col("model"))).join(rules, "kind").where(F.col("norm").startswith(F.col("prefix")))
    return met.groupBy(key).agg(F.max_by("to", F.struct(F.length("prefix"), -F.col("ord"))).alias("maker"))


PIECES = "array<struct<field_key:string,label:string,piece:string>>"


def names_composite(label: Column, rules: RuleSet) -> Column:
    return ascii_label(label).isin(*rules.composite_rules())


def composite_pieces(label: Column, value: Column, rules: RuleSet) -> Column:
    """array<(field_key, label, piece)> of a value whose label names several fields; null where no rule fits it.

    A rule's separator must give as many parts as it has fields, of which a
    null one drops its part; a rule's pattern must match the whole value, and
    its named groups are fields. Empty parts go. Rules become literals of one
    CASE, so that each pattern is compiled once.
    """
    norm, whole = ascii_label(label), strip(value)
    case = F.when(F.lit(False), F.array().cast(PIECES))
    told = names_composite(label, rules)  # what no rule names meets none of them
    for key, rule in rules.composite_rules().items():
        piece = lambda field, name, part: F.struct(F.lit(field).alias("field_key"), name.alias("label"), strip(part).alias("piece"))
        if rule.get("pattern"):
            # groups by number, as their names may hold what a Java group's can't
            groups = re.compile(rule["pattern"]).groupindex
            pattern = "^(?:" + re.sub(r"\(\?P=(\w+)\)", lambda m, g=groups: f"\\{g[m[1]]}", re.sub(r"\(\?P<\w+>", "(", rule["pattern"])) + ")$"
            fits = whole.rlike(pattern)
            parts = [piece(f, F.concat(label, F.lit(f" -> {f}")), F.regexp_extract(whole, pattern, i)) for f, i in groups.items()]
        else:
            sep, fields = rule.get("separator") or "/", rule.get("fields") or []
            cut = F.split(value, r"\Q" + sep + r"\E")
            names = [x.strip() for x in rule["label"].split(sep)]
            fits = F.size(cut) == len(fields)
            parts = [piece(f, F.lit(names[i]) if len(names) == len(fields) else label, F.get(cut, F.lit(i))) for i, f in enumerate(fields) if f is not None]
        case = case.when((norm == key) & fits, F.filter(F.array(*parts).cast(PIECES), lambda p: p["piece"] != ""))
    return F.when(told, case)


def split_composites(values: DataFrame, rules: RuleSet, key: str = "value_id") -> DataFrame:
    """(key, field_key, piece) of values (key, label, value) whose label names several fields."""
    pieces = composite_pieces(F.col("label"), F.col("value"), rules)
    return values.select(key, F.inline(F.transform(pieces, lambda p: F.struct(p["field_key"].alias("field_key"), p["piece"].alias("piece")))))


def is_unit(value: Column | str, units: list[str], label: Column | None = None) -> Column:
    """A unit as it stands or but for punctuation, or a note in parentheses without a digit. ``label`` is its ``ascii_label``, where that is at hand."""
    up = F.upper(strip(value))
    norm = ascii_label(F.col(value) if isinstance(value, str) else value) if label is None else label
    known = [u.upper() for u in units]
    loose = ["".join(ch for ch in u.upper() if ch.isascii() and ch.isalnum()) for u in units]
    note = up.startswith("(") & up.rlike(r"^\(.*\)$") & ~up.rlike(r"\d") & (F.length(up) > 2)
    return F.coalesce(up.isin(*known) | ((norm != "") & norm.isin(*[x for x in loose if x])) | note, F.lit(False))


def header_kind(value: Column | str) -> Column:
    """max, nor, min or design of a column's heading, else null."""
    up = F.rtrim(F.upper(strip(value)), F.lit("."))
    return F.when(up.isin("MAX", "MAXIMUM"), "max").when(up.isin("NOR", "NORM", "NORMAL"), "nor").when(up.isin("MIN", "MINIMUM"), "min").when(up.isin("DESIGN", "DES"), "design")


def carry_header(cells: DataFrame, group: list[str]) -> DataFrame:
    """(group, row, anchor): the column of the last header row above that shows the normal operating value.

    A header row names at least two of maximum, normal, minimum and design. One
    without a normal column ends the one before it.
    """
    rows = cells.withColumn("kind", header_kind(F.col("value"))).groupBy(*group, "row").agg(F.count_distinct("kind").alias("kinds"), F.min(F.when(F.col("kind") == "nor", F.col("col"))).alias("nor"))
    # -1 stands for a header without a normal column
    here = F.when(F.col("kinds") >= 2, F.coalesce("nor", F.lit(-1)))
    above = F.nullif(F.last(here, ignorenulls=True).over(Window.partitionBy(*group).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return rows.select(*group, "row", above.alias("anchor"))


def first_hits(hits: DataFrame, order: list[str]) -> DataFrame:
    """The first hit of each document and field in scan order."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "field_key").orderBy(*order))
    return hits.withColumn("rank", rank).where("rank = 1").drop("rank")
