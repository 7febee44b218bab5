"""Operators around scoring, review and the run log, on small tables of their own."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from docsift.functions import geometry, text
from docsift.operators import lookup, reports, resolve
from docsift.rules import RuleSet, set_guidance
from docsift.sources import runlog
from docsift.streaming import events


@pytest.mark.parametrize(("value", "is_string", "want"), [("195.0", False, "195"), ("195.0", True, "195.0"), ("? 4 in", True, "4 in"), (" n/a ", True, None), (None, True, None), ("?", True, None)])
def test_gold_text(spark, value, is_string, want):
    assert spark.range(1).select(reports.gold_text(F.lit(value).cast("string"), F.lit(is_string))).first()[0] == want


SCORED = [
    ("Class  300", "CLASS 300", "EXACT", ""),
    ("4-20", "4 20", "NOTATION", ""),
    ("160 ℃", "160.0", "NOTATION", ""),
    ("195", "195 (Cg=4040)", "PENDING_NORM", "GAP"),
    ("FAIL CLOSE", "VALVE SHUT", "PENDING_NORM", "GAP"),
    ("SOUTH", "NORTH", "WRONG", "GAP"),
    ("SOUTH", None, "MISSING", ""),
]


def test_text_scorer(spark):
    gold = spark.createDataFrame([(k, "f", "ann", t, True, None) for k, (t, *_) in enumerate(SCORED)], "doc_id int, field_key string, labeler string, truth string, is_string boolean, numeric boolean")
    values = spark.createDataFrame([(k, "f", g, g) for k, (_, g, *_) in enumerate(SCORED)], "doc_id int, field_key string, got string, normalised string")
    aliases = spark.createDataFrame([("f", "valve-shut", "Fail close", True, 0), ("f", "FAIL CLOSE", "Fail close", True, 0)], "field_key string, raw string, to string, compare_only boolean, ord int")
    scored = reports.score_text(gold, values, aliases)
    got = {r.doc_id: (r.verdict, r.rule_state) for r in scored.collect()}
    assert got == {k: (v, s) for k, (*_, v, s) in enumerate(SCORED)}
    counts = {r.labeler: r.cells for r in reports.labeler_counts(scored).collect()}
    assert counts == {"ann": 7, "HUMAN": 7}
    assert reports.labeler_counts(scored.limit(0)).count() == 0


def test_upper_median(spark):
    rows = spark.createDataFrame([(x, "normal") for x in (1.0, 2.0, 3.0, 4.0)], "ratio double, check string")
    assert reports.plausible_range(rows).first().asDict() == {"n": 4, "median": 3.0, "largest": 4.0}


def test_crop_scale_and_settings(spark):
    row = spark.range(1).select(
        geometry.crop_box(geometry.box(*[F.lit(x) for x in (0.4, 0.5, 0.6, 0.51)]), F.lit(1000), F.lit(2000)).alias("box"),
        geometry.crop_box(geometry.box(*[F.lit(x) for x in (0.4, 0.5, 0.6, 0.51)]), F.lit(5), F.lit(2000)).alias("thin"),
        *[geometry.plan_scale(F.lit(w), F.lit(10), 100).alias(f"s{w}") for w in (200, 80, 40, 0)],
        geometry.plan_scale(F.lit(0), F.lit(0), 100).alias("none"),
    ).first()
    assert tuple(row.box) == (0, *[int(x) for x in ((0.5 - 0.035) * 2000, (0.6 + 0.08) * 1000, (0.51 + 0.035) * 2000)]) and row.thin is None
    assert (row.s200, row.s80, row.s40, row.s0, row.none) == (0.5, 1.0, 2.0, 2.0, None)
    assert [geometry.setting(v, 1024, 16384, 5000, off=0) for v in ("2048", "0", "7", "x", None)] == [2048, 0, 5000, 5000, 5000]


def test_absence_note(spark):
    note = lambda *parts: spark.range(1).select(text.absence_note(*[F.lit(p).cast("string") for p in parts])).first()[0]
    assert note(None, "unreadable", " a b ", "box ") == "not read: the item is there, its value can't be read | row: a b | box"
    assert note(None, None, None, None) == "not found in the document"
    assert note("x", "unreadable", "", None) == ""


def test_marks_are_tall_merges_that_name_a_section(spark):
    cells = spark.createDataFrame([("d", 1, 1, 1, "Valve Body"), ("d", 1, 5, 1, "ACTUATOR"), ("d", 1, 9, 1, "Other"), ("d", 1, 1, 2, "Size")], "doc_id string, page int, row int, col int, value string")
    merges = spark.createDataFrame([("d", 1, 1, 1, 4, 1), ("d", 1, 5, 1, 5, 3), ("d", 1, 9, 1, 12, 1)], "doc_id string, page int, r0 int, c0 int, r1 int, c1 int")
    marks = lookup.section_marks(cells, merges, RuleSet().section_aliases(spark))
    assert [(r.section, r.lo, r.hi, r.col) for r in marks.collect()] == [("body", 1, 4, 1)]
    assert sorted(r.value for r in lookup.without_marks(cells, marks).collect()) == ["ACTUATOR", "Other", "Size"]


def test_rules_by_kind_and_first_alias(spark):
    rules = RuleSet()
    assert {r.field_key for r in rules.fields_of(spark, "required").collect()} >= {"tag"}
    assert "tag" in {r.field_key for r in rules.fields_of(spark, "human").collect()}
    index = {r.norm: r.field_key for r in rules.alias_index(spark).collect()}
    assert index["TAGNO"] == "tag"
    assert "TYPE" not in {r.norm for r in rules.alias_index(spark, only_mvp=True).collect()}


def test_guidance_is_replaced_and_removed(tmp_path):
    path = str(tmp_path / "guidance.yaml")
    assert set_guidance(path, "tag", "look top right", by="ann", today="2024-01-01") is None
    assert set_guidance(path, "tag", "look left") == "look top right\n"
    assert yaml.safe_load(open(path))["fields"]["tag"] == {"text": "look left\n"}
    assert set_guidance(path, "tag", " ") == "look left\n"
    assert yaml.safe_load(open(path))["fields"] == {}


def test_cache_keeps_what_it_has(spark, tmp_path):
    path = str(tmp_path / "cache")
    put = lambda *rows: runlog.put_answers(spark, path, spark.createDataFrame(rows, "key string, payload string"))
    spark.createDataFrame([("a", "1")], "key string, payload string").write.json(path)
    put(("a", "2"), ("b", "4"), ("b", "3"))
    put(("b", "9"))
    assert sorted(tuple(r) for r in spark.read.schema("key string, payload string").json(path).collect()) == [("a", "1"), ("b", "3")]


def test_log_and_summary(spark, tmp_path):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    raw = spark.createDataFrame([("d", "tag", "10-FV-001", "Tag No", 0.99, None)], "doc_id string, field_key string, raw_value string, raw_label string, confidence double, note string")
    log = events.stage_events(resolve.resolve(raw, docs), "r1").withColumn("ts", F.lit(2.0))
    path = str(tmp_path / "log")
    runlog.append_events(log, path)
    again = events.read_events(spark, path, stream=False)
    assert again.count() == log.count()
    runlog.write_summary(again, str(tmp_path / "summary"), {"rules": "abc"})
    told = spark.read.json(str(tmp_path / "summary")).first()
    assert told.run_id == "r1" and told.rules == "abc" and told.elapsed == 0.0 and told.counters["state:auto"] == 1


def test_fixture_and_candidates(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"doc_id": "d", "fields": [{"key": "tag", "value": "A10FV001", "state": "auto"}]}))
    bad.write_text(json.dumps({"doc_id": "d", "fields": [{"key": "colour", "value": "red"}]}))
    fields = RuleSet().fields(spark)
    row = runlog.records_fixture(spark, str(good), fields).first()
    assert (row.field_key, row.value, row.required, row.safety) == ("tag", "A10FV001", True, "identity")
    with pytest.raises(ValueError, match="colour"):
        runlog.records_fixture(spark, str(bad), fields)
    (tmp_path / "c.json").write_text(json.dumps({"summary": {"fields": 1}, "rows": [{"field_key": "maker", "value": "X", "count": 2, "docs": ["d"]}]}))
    assert [(r.value, r["count"]) for r in runlog.approval_candidates(spark, str(tmp_path / "c.json")).collect()] == [("X", 2)]


def test_files_are_found_by_name(spark, tmp_path):
    for name in ("a/One.pdf", "b/one.PDF", "b/two.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = spark.createDataFrame([("ONE.pdf",), ("three.pdf",)], "file string")
    got = {r.file: r.path for r in runlog.locate(rows, runlog.list_files(spark, str(tmp_path))).collect()}
    assert got["ONE.pdf"].endswith("/a/One.pdf") and got["three.pdf"] is None


def test_gold_sheet_by_labels(spark):
    cells = [(1, 10, "Tag No"), (1, 12, "Colour"), (2, 10, "Truth"), (2, 11, "Label"), (2, 12, "Truth"), (3, 1, "d1"), (3, 2, "a.pdf"), (3, 10, "T1"), (3, 11, "Tag"), (3, 12, "red"), (4, 1, "d2"), (4, 10, "T2")]
    cells = spark.createDataFrame([("kit", *c, True) for c in cells], "doc_id string, row int, col int, value string, is_string boolean")
    gold, unknown = runlog.gold_by_labels(cells, RuleSet().alias_index(spark), {1: "id", 2: "file"}, "Truth")
    assert [(r.id, r.file, r.field_key, r.truth) for r in gold.collect()] == [("d1", "a.pdf", "tag", "T1")]
    assert [r.name for r in unknown.collect()] == ["Colour"]


def test_text_pdf_and_formats(spark):
    pages = spark.createDataFrame([("a", k, "x" * 70) for k in (1, 2, 3)] + [("b", k, "x" * 50) for k in (1, 2, 3, 4, 5)] + [("c", 1, None)], "doc_id string, page int, text string")
    assert {r.doc_id: r.is_text for r in reports.is_text_pdf(pages).collect()} == {"a": True, "b": False, "c": False}
    kinds = spark.createDataFrame([("tiff",), ("xlsm",), ("pdf",), ("txt",)], "e string").select(reports.format_bucket(F.col("e"))).collect()
    assert [r[0] for r in kinds] == ["tif", "xlsx", "pdf", None]
