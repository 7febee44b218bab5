import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docsift.functions import geometry, tags, text

SAME = [
    ("142.6 m3/Hr", "142.6 m³/h", None, True),
    ("1-1/2\"", "1 1/2 in", None, True),
    ("CLASS IV", "class 4", None, True),
    ("A351 CF8M", "A351 CF3M", None, False),
    ("N/A", "-", None, True),
    ("N/A", "0", None, False),
    ("ILLEGIBLE", "UNREADABLE", None, True),
    ("?316SST", "316 sst", None, True),
    ("30 m?h", "30 m3/h", True, True),
    ("abc", "abd", True, False),
    ("10 bar", "10 psi", False, False),
]


def test_same_value(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SAME)], "i int, gold string, got string, numeric boolean, want boolean")
    got = rows.select("i", text.same_value(F.col("gold"), F.col("got"), F.col("numeric")).alias("same")).collect()
    assert {r.i: r.same for r in got} == {i: r[3] for i, r in enumerate(SAME)}


@pytest.mark.parametrize(
    ("value", "want"),
    [("XIV", "16"), ("XIX", "21"), ("4\" X 4\"", "4\" 10 4\""), ("I/P", "1/P"), ("CLASS VI", "CLASS 6"), ("VALVE", "VALVE")],
)
def test_roman(spark, value, want):
    assert spark.range(1).select(text.roman_to_arabic(F.lit(value))).first()[0] == want


def test_small_functions(spark):
    one = spark.range(1).select(
        text.norm_number(F.lit("x .933 1.5")).alias("number"),
        text.norm_alias(F.lit('1/2"'), F.lit(True)).alias("alias"),
        text.join_notes(F.lit(" a "), F.lit(None).cast("string"), F.lit("b")).alias("notes"),
        text.document_id(F.lit("/x/My File.v2.pdf")).alias("doc"),
        text.inches(F.lit("1-1/2")).alias("inches"),
        text.flow_coefficient(F.lit(10.0), F.lit(1.0), F.lit(0.0)).alias("cv"),
        text.found(F.lit(" \t")).alias("found"),
    ).first()
    assert tuple(one) == ("x 0.933 1.5", "1/2", "a | b", "My_File.v2", 1.5, None, False)


def test_tags(spark):
    cases = {"10-FV-001": "A10FV001", "b 010 fv 12a": "B10FV12A", "1E7924": None, "Quote No. 85-1874": None, "": None, "１０－ＦＶ－００１": "A10FV001"}
    rows = spark.createDataFrame([*cases.items()], "t string, want string").select("t", tags.parse_tag(F.col("t"))["key"].alias("key"))
    assert {r.t: r.key for r in rows.collect()} == cases
    runs = spark.createDataFrame([("10-FV-012/013/014",), ("10FV012A/B",), (None,), ("10-FV-012A/013B/C",), ("10-FV-012A/013/B",), ("10-FV-011 / 2003",), ("10-FV-011/012 20-PV-1A, B",)], "t string").select(tags.find_tags("t").alias("k")).collect()
    assert [list(r.k) for r in runs] == [["A10FV012", "A10FV013", "A10FV014"], ["A10FV012A", "A10FV012B"], [], ["A10FV012A", "A10FV013B", "A10FV012C"], ["A10FV012A", "A10FV013", "A10FV012B"], ["A10FV011"], ["A10FV011", "A10FV012"]]


def test_file_names(spark):
    cases = {"10FV012-AB CALC_REV0.pdf": (None, None, "A10FV012", 0), "x/B10PV018-REPIAR REPORT_REV1.xlsx": ("REPAIR REPORT", True, "B10PV018", 1), "DATA SHEEET.tif": ("DATA SHEET", True, None, None), "20LV009_INSTURMENT LIST.pdf": ("INSTRUMENT LIST", False, "A20LV009", None)}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", tags.parse_filename(F.col("t")).alias("n")).collect()
    assert {r.t: (r.n.doc_kind, r.n.in_scope, r.n.tag, r.n.revision) for r in rows} == cases


def test_compatible_forms(spark):
    odd = ["plain", "", None, "３００ ㎜", "ｃｍ²", "½ ﬁ ℃", "ﾊﾟ", "판독불가", "①Ⅳ…", "𝟙𝟚"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select("t", text.compat(F.col("t")).alias("c")).collect()
    folded = lambda x: "".join(unicodedata.normalize("NFKC", ch) for ch in x)
    assert [r.c for r in rows] == [x if x is None else folded(x) for x in odd]


def test_dates_and_marks(spark):
    cases = [("2003.5.7", (2003, 5, 7, False)), ("AUG 24, 1986", (1986, 8, 24, False)), ("24 AUG 1986", (1986, 8, 24, False)), ("13/02/1999", (1999, 2, 13, False)), ("03/02/1999", (1999, 3, 2, True)), ("rev 1986", (1986, 0, 0, False)), ("24-AUG-1986", (1986, 0, 0, False)), ("２００３．５．７", (2003, 5, 7, False)), ("no", None)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "t string").select(tags.parse_date(F.col("t")).alias("d")).collect()
    assert [None if r.d is None else tuple(r.d) for r in rows] == [w for _, w in cases]
    marks = spark.createDataFrame([("OLD as-built",), ("As Built",), ("GOLD",)], "t string").select(tags.find_mark(F.col("t"))["mark"].alias("m")).collect()
    assert [r.m for r in marks] == ["OLD", "AS-BUILT", None]


def test_boxes_come_back(spark):
    got = spark.createDataFrame([(30.0, 100.0, 50.0)], "a double, w double, h double")
    got = got.withColumn("r", geometry.rotation(F.col("a"), F.col("w"), F.col("h"))).withColumn("m", F.col("r.m")).withColumn("i", geometry.invert(F.col("m")))
    both = got.withColumn("c", geometry.compose(F.col("i"), F.col("m"))).first()
    assert [round(x, 9) for x in both.c] == [1, 0, 0, 0, 1, 0]
    assert (both.r.width, both.r.height) == (112, 94)


def test_compatible_ideographs_beyond_the_basic_plane(spark):
    odd = [chr(x) for x in range(0x2F800, 0x2FA1E)]
    rows = spark.createDataFrame([(f"a{x}b",) for x in odd], "t string").select("t", text.compat(F.col("t")).alias("c")).collect()
    assert len(rows) == len(odd) and all(r.c == unicodedata.normalize("NFKC", r.t) for r in rows)


def test_short_ways_give_the_same_forms(spark):
    """Clean texts, texts without roman numbers and without digits go short ways, with the results of the long ones."""
    odd = ["", " ", "?", "??", " ?x ", "x?", "x \u2028", "12 mm\u2028", "a\n", "\ta", "a\u00a0", "XIV", "xii bar", "SHIP IN IV", "IV_2", "x-i", "ÉIV", "ⅣX", "３００", "CLASS IV\u2029", "12\n3", "- 5 -7", "mm", "°C", "1e5 m3", "DELIVER IN PERSON", None]
    table = F.create_map(*[F.lit(x) for pair in text.ROMAN.items() for x in pair])
    plain = F.coalesce(F.col("v"), F.lit(""))
    cleaned = text.strip(F.regexp_replace(text.strip(text.compat(plain)), r"^\?", ""))
    words = F.split(F.upper(F.col("cleaned_long")), r"(?U)\b")
    arabic = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")
    tokens = F.regexp_extract_all(F.col("arabic_long"), F.lit(f"({text.TOKEN})"), 1)
    kept = F.array_join(F.filter(tokens, lambda t: ~(t.rlike(r"^[\p{L}°℃℉]") & F.lower(t).isin(*text.UNITS))), "")
    rows = spark.createDataFrame([(v,) for v in odd], "v string").withColumn("cleaned_long", cleaned).withColumn("arabic_long", arabic).withColumn("kept_long", kept)
    rows, (forms,) = text.with_forms(rows, "v")
    numbers = lambda c: (text._is_numeric(c), text._numbers(c))
    got = rows.select("cleaned_long", forms.cleaned, "arabic_long", forms.arabic, *[x for c in (F.col("kept_long"), forms.kept) for x in numbers(c)], forms.kept).collect()
    for r in got:
        assert (r[0], r[2], r[4], r[5]) == (r[1], r[3], r[6], r[7])
        assert any("0" <= x <= "9" for x in r[3]) or r[8] == ""


def test_named_columns_are_stripped_alike(spark):
    """Without the pattern, whatever stands at the ends: all its blanks, blanks it doesn't know, and separators before which $ stands."""
    rng = random.Random(4)
    alphabet = [*text.BLANK_CHARS, *"ab한\u2028\u2029\u200b\u3000\x1b"]
    values = [None, "", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(5000))]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.where(~text.strip("v").eqNullSafe(text.strip(F.col("v")))).count() == 0


def test_notes_are_joined_without_lambdas(spark):
    df = spark.createDataFrame([(" a ", None, "b\n"), (None, " ", ""), ("\xa0", "x | y", None)], "p string, q string, r string")
    joined = df.select(text.join_notes(F.col("p"), F.col("q"), F.col("r")).alias("n"))
    assert [r.n for r in joined.collect()] == ["a | b", "", "x | y"]
    assert "lambda" not in joined._jdf.queryExecution().analyzed().toString()
