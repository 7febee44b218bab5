import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift.operators import crosscheck, evaluate, lookup, resolve, triage, vocabulary
from docsift.rules import RuleSet
from docsift.sources import files, layouts

PAGE = "doc_id int, page int, is_spec boolean, superseded boolean, tags array<string>, date_key struct<y:int,m:int,d:int>, date_ambiguous boolean, mark string, file_tag string"


def page(doc, number, *, spec=True, old=False, tags=("T",), date=None, unsure=False, mark=None, file_tag=None):
    return doc, number, spec, old, list(tags), date, unsure, mark, file_tag


PICKS = [
    ([page(1, 1, spec=False)], (None, "NO_SPEC")),
    ([page(2, 1, spec=False), page(2, 2)], (2, "ONE_SPEC")),
    ([page(3, 1, old=True), page(3, 2, old=True)], (None, "ALL_SUPERSEDED")),
    ([page(4, 1, old=True), page(4, 2)], (2, "ONE_LIVE")),
    ([page(5, 1, tags=["A"], file_tag="B"), page(5, 2, tags=["B"], file_tag="B")], (2, "FILE_TAG")),
    ([page(6, 1, tags=["A"]), page(6, 2, tags=["B"])], (None, "MANY_ASSETS")),
    ([page(7, 1, date=(2003, 1, 1)), page(7, 2, date=(1986, 1, 1))], (1, "LATEST_YEAR")),
    ([page(8, 1, date=(2003, 1, 1)), page(8, 2, date=(2003, 2, 1))], (2, "LATEST_DATE")),
    ([page(9, 1, date=(2003, 1, 1), unsure=True), page(9, 2, date=(2003, 2, 1), mark="RETROFIT")], (2, "RETROFIT")),
    ([page(10, 1), page(10, 2)], (None, "UNDECIDED")),
    ([page(11, 1, mark="AS-BUILT"), page(11, 2, mark="RETROFIT")], (1, "AS-BUILT")),
]


def test_latest_page(spark):
    rows = spark.createDataFrame([p for pages, _ in PICKS for p in pages], PAGE)
    got = {r.doc_id: (r.page, r.rule) for r in triage.pick_latest(rows).collect()}
    assert got == {pages[0][0]: want for pages, want in PICKS}


def test_resolve_chain(spark):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    raw = [("d", "tag", "10-FV-001", "Tag No", 0.99), ("d", "fail_action", "ATO", "Fail Action", 0.99), ("d", "rating", "Class 300", "Rating", 0.99), ("d", "maker", "NORTHGATE", "Maker", 0.5), ("d", "rated_cv", "n.a. Cv", "Cv", 0.99)]
    rows = spark.createDataFrame([(*r, None) for r in raw], "doc_id string, field_key string, raw_value string, raw_label string, confidence double, note string")
    got = {r.field_key: (r.value, r.state, r.failure) for r in resolve.resolve(rows, docs).collect()}
    assert got["fail_action"] == ("FAIL CLOSE", "auto", "NONE")
    assert got["rating"] == ("300#", "auto", "NONE")
    assert got["maker"] == ("NORTHGATE", "review", "NONE")
    assert got["rated_cv"][1:] == ("review", "FORMAT")
    assert got["model"] == (None, "na", "NO_EVIDENCE")
    assert got["type_name"][:2] == ("Flow Control Valve", "review")
    counts = resolve.state_counts(resolve.resolve(rows, docs)).first()
    assert (counts.auto, counts.review, counts.na, counts.approvable) == (3, 3, 2, False)


@pytest.mark.parametrize(("raw", "value", "fits"), [("ATO OPEN", "FAIL OPEN", False), ("AIR TO OPEN", "FAIL CLOSE", True), ("FAILS CLOSE", "FAIL CLOSE", True), ("FAILS CLOSE", "FAIL OPEN", False), ("LAST", "FAIL LAST", True)])
def test_fail_parity(spark, raw, value, fits):
    assert spark.range(1).select(resolve.fail_parity(F.lit(raw), F.lit(value))).first()[0] is fits


def test_last_action_counts(spark):
    records = spark.createDataFrame([("d", "a", "x", "auto", "normal"), ("d", "b", None, "na", "normal")], "doc_id string, field_key string, value string, state string, safety string")
    actions = spark.createDataFrame([("d", "b", 1, "override", "1"), ("d", "b", 2, "override", "2"), ("d", "a", 1, "approve", None), ("d", "a", 2, "undo", None)], "doc_id string, field_key string, seq int, action string, human_value string")
    got = {r.field_key: (r.final_value, r.action, r.resolved) for r in resolve.apply_actions(records, actions).collect()}
    assert got == {"a": ("x", None, True), "b": ("2", "override", True)}


def test_crosscheck(spark):
    kind = "doc_id string, field_key string, value string"
    a = spark.createDataFrame([("d", "f", "10 bar"), ("d", "g", "x"), ("d", "h", "N/A"), ("d", "i", "A"), ("d", "j", "3 psi 7")], kind)
    b = spark.createDataFrame([("d", "f", "10 BAR"), ("d", "h", "7"), ("d", "i", "B"), ("d", "j", "3/7 zz")], kind)
    wanted = spark.createDataFrame([(k, None) for k in "fghij"], "field_key string, numeric boolean")
    got = {r.field_key: r.state for r in crosscheck.crosscheck(a, b, wanted).collect()}
    assert got == {"f": "AGREE", "g": "VLM_ONLY", "h": "TEXT_ONLY", "i": "CONFLICT", "j": "NOTATION"}


def test_judge(spark):
    cases = [("N/A", None, None, "EXACT"), ("N/A", "x", "x", "FABRICATED"), ("x", None, None, "MISSING"), ("x", "X.", None, "EXACT"), ("x", "y", "x", "EXACT"), ("CLASS 300", "y", "300", "PENDING_NORM"), ("x", "y", "z", "WRONG")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, truth string, got string, raw string, want string")
    got = rows.select("want", evaluate.judge(F.col("truth"), F.col("got"), F.col("raw")).alias("v")).collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_nearest_and_suggest(spark):
    values = spark.createDataFrame([("DIAPHRAGN",), ("zzz",), (None,)], "value string")
    got = {r.value: r.nearest for r in vocabulary.nearest(values, ["DIAPHRAGM", "PISTON"]).collect()}
    assert got == {"DIAPHRAGN": "DIAPHRAGM", "zzz": None, None: None}
    label = spark.createDataFrame([("Model Number",), ("Q",)], "label string")
    assert {r.label: r.suggestion for r in vocabulary.suggest(label, ["MODEL"]).collect()} == {"Model Number": "MODEL", "Q": None}


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="SPEC" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Rating</t></si><si><t>mm</t></si><si><t>Class 300</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="s"><v>1</v></c><c r="E2" t="s"><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="B2:C2"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbook_to_records(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    found = files.read_files(spark, str(tmp_path), "*.xlsx")
    cells = files.workbook_cells(found)
    assert files.merged_index(files.workbook_merges(found)).count() == 2
    got = layouts.grid_records(cells, files.workbook_merges(found), RuleSet()).collect()
    assert [(r.doc_id, r.field_key, r.raw_value, r.source_locator) for r in got] == [("a", "rating", "Class 300", "SPEC!E2")]
    assert files.page_texts(cells).first().text == "Rating\nmm\nClass 300"


def test_spans_to_records(spark):
    kind = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, dir_x double, dir_y double"
    rows = [("d", 1, 10.0, 10.0, 50.0, 20.0, "Tag No : 10-FV-001", 1.0, 0.0), ("d", 1, 10.0, 40.0, 50.0, 50.0, "Maker", 1.0, 0.0), ("d", 1, 90.0, 42.0, 99.0, 50.0, "NORTHGATE", 1.0, 0.0), ("d", 1, 5.0, 40.0, 8.0, 90.0, "BODY", 0.0, 1.0)]
    got = {r.field_key: r.raw_value for r in layouts.span_records(spark.createDataFrame(rows, kind), RuleSet()).collect()}
    assert got == {"tag": "10-FV-001", "maker": "NORTHGATE"}


def test_tiff_frames(spark, tmp_path):
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 640) + struct.pack("<HHII", 257, 4, 1, 480)
    raw = b"II*\0" + struct.pack("<I", 8) + ifd + struct.pack("<I", 8 + len(ifd) + 4) + ifd + struct.pack("<I", 0)
    (tmp_path / "p.tif").write_bytes(raw)
    got = files.tiff_pages(files.read_files(spark, str(tmp_path), "*.tif")).collect()
    assert [(r.page, r.width, r.height) for r in got] == [(1, 640, 480), (2, 640, 480)]


def test_rules_from_yaml(spark, tmp_path):
    (tmp_path / "fields.yaml").write_text("fields:\n  - {key: size, name: Size, required: true, aliases: [Dia]}\n")
    (tmp_path / "rules.yaml").write_text("punct_significant: [size]\nvalue_aliases:\n  size:\n    - {from: [half], to: '1/2'}\n")
    rules = RuleSet.load(str(tmp_path / "fields.yaml"), str(tmp_path / "rules.yaml"), str(tmp_path / "none.yaml"))
    assert rules.fields(spark).first().punctuation
    assert {r.raw for r in rules.aliases(spark).collect()} == {"half", "1/2"}
    assert len(rules.hashes) == 2


def most_rows(df):
    """The most rows that any step of a plan gave, once it has run."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
            continue
        if name.endswith("QueryStage"):
            plans.append(plan.plan())
        count = plan.metrics().get("numOutputRows")
        if count.isDefined():
            most = max(most, count.get().value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


@pytest.mark.parametrize("at", [lookup.sections_at, lookup.bands_at])
def test_marks_of_a_crowded_page_do_not_meet_all_its_points(spark, at):
    rng = random.Random(5)
    points = [(i, 1, rng.uniform(0, 100), rng.randrange(40)) for i in range(1000)] + [(-1, 1, None, 3), (-2, 2, 5.0, 3)]
    marks = [(1, f"s{i}", lo := rng.uniform(-5, 100), lo + rng.choice([-1, 0, 3, 60]), rng.randrange(40), i) for i in range(1000)] + [(3, "x", 0.0, 9.0, 0, 1)]
    # a bound on a position, and one mark over all
    marks += [(1, "edge", points[0][2], points[1][2], 0, 1000), (1, "all", -9.0, 200.0, -1, 1001)]
    got = at(spark.createDataFrame(points, "point_id long, page int, pos double, col int"), spark.createDataFrame(marks, "page int, section string, lo double, hi double, col int, ord int"), ["page"])

    def best(page, pos, col):
        fits = [(m[4], -m[5], m[1]) for m in marks if m[0] == page and pos is not None and m[2] <= pos <= m[3] and m[4] < col]
        return max(fits, default=(None, None, None))

    want = {i: best(page, pos, col) for i, page, pos, col in points}
    assert {r.point_id: r.section for r in got.collect()} == {i: b[2] for i, b in want.items()}
    if "band" in got.columns:
        assert {r.point_id: r.band for r in got.collect()} == {i: b[0] for i, b in want.items()}
    assert most_rows(got) < 50_000


def test_export_gathers_documents_once(spark, capsys):
    """Rows aren't multiplied by attributes before the shuffle; a document without any of the keys, or without an id, keeps its rows."""
    rows = [("a", "f1", "x", None), ("a", "f2", None, "s"), ("b", "f9", "y", "t"), (None, "f2", "z", "u")]
    got = files.export_table(spark.createDataFrame(rows, "doc_id string, field_key string, value string, state string"), ["f1", "f2"], ["value", "state"])
    assert got.columns == ["doc_id", "attribute", "f1", "f2"]
    assert {tuple(r) for r in got.collect()} == {("a", "value", "x", None), ("a", "state", None, "s"), ("b", "value", None, None), ("b", "state", None, None), (None, "value", None, "z"), (None, "state", None, "u")}
    got.explain()
    assert "Expand" not in capsys.readouterr().out
