"""Queries of the engine over the shared tables, each with SQL that says the same.

The tables hold no datasheets, so every operator runs on a projection that
gives a table the operator's input shape; the SQL uses the same projection.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import geometry, tags, text
from docsift.operators import crosscheck, evaluate, gold, lookup, resolve, triage, vocabulary
from docsift.rules import RuleSet, _field
from docsift.sources.files import export_table
from docsift.sources.tables import stored
from docsift.streaming import events as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("FROM lineitem", f"FROM {LINEITEM_SQL}").replace("JOIN (SELECT * FROM lineitem", f"JOIN (SELECT * FROM {LINEITEM_SQL}")
        return f

    return add


MODES = ("AIR", "MAIL", "RAIL", "SHIP", "TRUCK")
INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "HOLD", "TAKE BACK RETURN")
#: One line for each order and line number, with two more columns of words.
LINEITEM_SQL = f"""(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax,
  min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, {list(MODES)}[min(l_partkey) % 5 + 1] AS l_shipmode, {list(INSTRUCTIONS)}[min(l_suppkey) % 4 + 1] AS l_shipinstruct
  FROM lineitem GROUP BY l_orderkey, l_linenumber) AS lineitem"""


#: About so many lines meet in one task.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "lineitem":
        return found
    word = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    # by order before duplicates are sorted out: what follows by order or by order and line needs no other shuffle, and a task's sort doesn't grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // TASK_ROWS + 1)
    one = found.repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*least)
    return one.withColumns({"l_shipmode": word(MODES, F.col("l_partkey") % 5), "l_shipinstruct": word(INSTRUCTIONS, F.col("l_suppkey") % 4)})


#: Rules for the fields f1 to f7 that lineitem's line numbers stand for.
LINES = RuleSet(
    {
        "fields": [_field(f"f{i}", f"Field {i}", required=i <= 3, safety="safety" if i == 1 else "normal", threshold=0.95) for i in range(1, 8)],
        "value_aliases": {"f2": [{"from": ["CLASS 1", "CL 1"], "to": "1#"}, {"from": ["CLASS 2"], "to": "2#"}], "f3": [{"from": ["CLASS 3"], "to": "3#", "compare_only": True}]},
        "format_rules": {"f4": {"max_length": 7}, "f5": {"numeric": True}},
        "sections": {},
    }
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions: a document is an order, a field a line."""
    q = F.col("l_quantity").cast("int")
    raw = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("."), q.cast("string"))).when(F.col("l_returnflag") == "A", F.concat(F.lit(" class "), (q % 5).cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), raw.alias("raw_value"),
        F.col("l_shipmode").alias("raw_label"), (1 - F.col("l_discount")).alias("confidence"), F.lit(None).cast("string").alias("note"),
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    rows = resolve.complete(lines(spark, sf_dir), docs, LINES.fields(spark))
    return resolve.decide(resolve.failure(resolve.format_violations(resolve.normalise(rows, LINES), LINES)))


RECORDS_SQL = """
WITH f AS (SELECT 'f' || i AS field_key, i, i <= 3 AS required, CASE WHEN i = 1 THEN 'safety' ELSE 'normal' END AS safety FROM range(1, 8) t(i)),
e AS (
  SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS field_key, l_shipmode AS raw_label, 1 - l_discount AS confidence,
    CASE WHEN l_linestatus = 'O' THEN '.' || CAST(l_quantity AS INT) WHEN l_returnflag = 'A' THEN ' class ' || (CAST(l_quantity AS INT) % 5) || ' ' END AS raw_value
  FROM lineitem
), c AS (
  SELECT o_orderkey AS doc_id, f.*, raw_value, raw_label, confidence FROM orders CROSS JOIN f
  LEFT JOIN e ON e.doc_id = o_orderkey AND e.field_key = f.field_key
), n AS (
  SELECT *, CASE WHEN raw_value IS NULL THEN 'NONE'
      WHEN field_key = 'f2' AND upper(trim(raw_value)) IN ('CLASS 1', 'CLASS 2', '.1', '.2') THEN 'ALIAS'
      WHEN raw_value LIKE '.%' THEN 'NUMBER' ELSE 'RAW' END AS how,
    CASE WHEN field_key = 'f2' AND upper(trim(raw_value)) IN ('CLASS 1', '.1') THEN '1#'
      WHEN field_key = 'f2' AND upper(trim(raw_value)) IN ('CLASS 2', '.2') THEN '2#'
      WHEN raw_value LIKE '.%' THEN '0' || raw_value ELSE trim(raw_value) END AS value
  FROM c
), v AS (
  SELECT *, CASE WHEN value IS NULL THEN CASE WHEN required THEN 'required' ELSE '' END
      WHEN field_key = 'f4' AND length(value) > 7 THEN 'max_length'
      WHEN field_key = 'f5' AND NOT regexp_matches(value, '[0-9]') THEN 'numeric' ELSE '' END AS violations
  FROM n
), r AS (
  SELECT *, CASE WHEN value IS NULL THEN 'NO_EVIDENCE' WHEN violations <> '' THEN 'FORMAT' ELSE 'NONE' END AS failure FROM v
), d AS (
  SELECT *, CASE WHEN failure = 'NO_EVIDENCE' THEN 'na' WHEN failure <> 'NONE' THEN 'review'
    WHEN coalesce(confidence < 0.95, true) THEN 'review' ELSE 'auto' END AS state FROM r
)
"""
COUNTS_SQL = (
    RECORDS_SQL
    + """, s AS (
  SELECT doc_id, count(*) FILTER (state = 'auto') AS auto, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'na') AS na,
    coalesce(bool_and(state = 'auto' AND safety = 'normal') FILTER (required), true) AS approvable
  FROM d GROUP BY doc_id
) """
)


@query(COUNTS_SQL + "SELECT * FROM s")
def q01_state_counts(spark, sf_dir):
    return resolve.state_counts(line_records(spark, sf_dir))


@query(
    COUNTS_SQL
    + """SELECT count(*) AS docs, CAST(sum(auto) AS BIGINT) AS auto, CAST(sum(review) AS BIGINT) AS review, CAST(sum(na) AS BIGINT) AS na,
  round_even(sum(auto) / greatest(sum(auto + review + na), 1), 4) AS auto_rate, count(*) FILTER (approvable) AS approvable FROM s"""
)
def q02_auto_rate_summary(spark, sf_dir):
    return resolve.run_summary(resolve.state_counts(line_records(spark, sf_dir)))


@query(RECORDS_SQL + "SELECT field_key, count(*) AS n, count(*) FILTER (raw_value IS NULL) AS missing, count(raw_label) AS labelled FROM c GROUP BY field_key")
def q03_required_left_join_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    rows = resolve.complete(lines(spark, sf_dir), docs, LINES.fields(spark))
    return rows.groupBy("field_key").agg(F.count("*").alias("n"), F.count_if(F.col("raw_value").isNull()).alias("missing"), F.count("raw_label").alias("labelled"))


@query(RECORDS_SQL + "SELECT field_key, how, value, count(*) AS n FROM n GROUP BY ALL")
def q04_alias_normalise(spark, sf_dir):
    return _normalised(spark, sf_dir).groupBy("field_key", "how", "value").agg(F.count("*").alias("n"))


def _normalised(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return resolve.normalise(resolve.complete(lines(spark, sf_dir), docs, LINES.fields(spark)), LINES)


FAIL_RAW = ("ATO", "A/C", "OPEN", "CLOSE", "LOCK", "FAIL CLOSE", "STD")
FAIL_SQL = """
WITH p AS (
  SELECT ['ATO', 'A/C', 'OPEN', 'CLOSE', 'LOCK', 'FAIL CLOSE', 'STD'][l_linenumber] AS raw_value,
    CASE l_shipmode WHEN 'AIR' THEN 'Air Fails Valve To' WHEN 'MAIL' THEN 'Fail/Air-To' ELSE 'Position' END AS raw_label FROM lineitem
), m AS (
  SELECT *, CASE raw_value WHEN 'ATO' THEN 'FAIL CLOSE' WHEN 'A/C' THEN 'FAIL OPEN' ELSE
      CASE WHEN raw_label = 'Air Fails Valve To' THEN CASE raw_value WHEN 'OPEN' THEN 'FAIL OPEN' WHEN 'CLOSE' THEN 'FAIL CLOSE'
        WHEN 'LOCK' THEN 'FAIL LAST' WHEN 'FAIL CLOSE' THEN 'FAIL CLOSE' ELSE raw_value END ELSE raw_value END END AS value
  FROM p
) """


def _fail_rows(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in FAIL_RAW]), F.col("l_linenumber").cast("int"))
    label = F.when(F.col("l_shipmode") == "AIR", "Air Fails Valve To").when(F.col("l_shipmode") == "MAIL", "Fail/Air-To").otherwise("Position")
    rows = table(spark, sf_dir, "lineitem").select(F.lit("fail_action").alias("field_key"), raw.alias("raw_value"), label.alias("raw_label"), F.lit(False).alias("punctuation"))
    return resolve.normalise(rows, RuleSet())


@query(FAIL_SQL + "SELECT raw_value, raw_label, value, count(*) AS n FROM m GROUP BY ALL")
def q05_domain_map_startswith(spark, sf_dir):
    return _fail_rows(spark, sf_dir).groupBy("raw_value", "raw_label", "value").agg(F.count("*").alias("n"))


@query(
    FAIL_SQL
    + """SELECT coalesce(((contains(raw_value, 'OPEN') <> contains(raw_value, 'CLOSE')) AND (contains(value, 'OPEN') <> contains(value, 'CLOSE'))
    AND (contains(raw_value, 'FAIL') <> ((contains(raw_value, 'OPEN') AND contains(value, 'OPEN')) OR (contains(raw_value, 'CLOSE') AND contains(value, 'CLOSE'))))) = false, true) AS fits,
  raw_value, count(*) AS n FROM m GROUP BY ALL"""
)
def q06_fail_action_parity(spark, sf_dir):
    return _fail_rows(spark, sf_dir).groupBy(resolve.fail_parity(F.col("raw_value"), F.col("value")).alias("fits"), "raw_value").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '0.' ELSE '12.' END || CAST(l_quantity AS INT) AS shown FROM lineitem")
def q07_numeric_format(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("."), q)).otherwise(F.concat(F.lit("12."), q))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.norm_number(raw).alias("shown"))


@query(RECORDS_SQL + "SELECT field_key, violations, count(*) AS n FROM v GROUP BY ALL")
def q08_format_violations(spark, sf_dir):
    rows = resolve.format_violations(_normalised(spark, sf_dir), LINES)
    return rows.groupBy("field_key", F.array_join("violations", " · ").alias("violations")).agg(F.count("*").alias("n"))


@query(RECORDS_SQL + "SELECT field_key, failure, state, count(*) AS n FROM d GROUP BY ALL")
def q09_decide_state(spark, sf_dir):
    return line_records(spark, sf_dir).groupBy("field_key", "failure", "state").agg(F.count("*").alias("n"))


@query(COUNTS_SQL + "SELECT doc_id FROM s WHERE approvable")
def q10_approvable_docs(spark, sf_dir):
    return resolve.state_counts(line_records(spark, sf_dir)).where("approvable").select("doc_id")


@query(
    """
WITH p AS (SELECT p_partkey AS label_id,
  ['Tag No.', 'Model No.', 'MAKER', 'Size (inch)', 'Cv', 'Unknown'][p_size % 6 + 1] AS label,
  CASE p_size % 5 WHEN 0 THEN 'body' WHEN 1 THEN 'actuator' END AS section FROM part)
SELECT label_id, CASE WHEN section IS NULL THEN CASE label WHEN 'Tag No.' THEN 'tag' WHEN 'MAKER' THEN 'maker' WHEN 'Size (inch)' THEN 'body_size' WHEN 'Cv' THEN 'rated_cv' END
  WHEN section = 'body' THEN CASE label WHEN 'Model No.' THEN 'model' WHEN 'Size (inch)' THEN 'body_size' END END AS field_key
FROM p WHERE field_key IS NOT NULL
"""
)
def q11_label_lookup_ambiguity(spark, sf_dir):
    size = F.col("p_size").cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Tag No.", "Model No.", "MAKER", "Size (inch)", "Cv", "Unknown")]), size % 6 + 1)
    rules = RuleSet()
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label_id"), label.alias("label"), F.when(size % 5 == 0, "body").when(size % 5 == 1, "actuator").alias("section"))
    labels = labels.join(rules.section_fields(spark), "section", "left")
    return lookup.lookup_labels(labels, rules.labels(spark)).select("label_id", "field_key")


@query(
    """
WITH marks AS (SELECT s_nationkey AS page, s_suppkey AS mark, s_suppkey % 50 AS lo, s_suppkey % 50 + 20 AS hi, s_suppkey % 7 AS col FROM supplier),
points AS (SELECT c_custkey AS point_id, c_nationkey AS page, c_custkey % 70 AS pos, c_custkey % 9 AS col FROM customer)
SELECT point_id, arg_max('s' || mark, (m.col, -mark)) AS section FROM points p
LEFT JOIN marks m ON m.page = p.page AND m.lo <= p.pos AND p.pos <= m.hi AND m.col < p.col GROUP BY point_id
"""
)
def q12_section_range_join(spark, sf_dir):
    k = F.col("s_suppkey")
    marks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.concat(F.lit("s"), k.cast("string")).alias("section"), (k % 50).alias("lo"), (k % 50 + 20).alias("hi"), (k % 7).alias("col"), k.alias("ord"))
    c = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(c.alias("point_id"), F.col("c_nationkey").alias("page"), (c % 70).alias("pos"), (c % 9).alias("col"))
    return lookup.sections_at(points, marks, ["page"])


@query(
    """
WITH v AS (SELECT p_partkey AS value_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || ' / ' || p_size END AS value FROM part)
SELECT value_id, unnest(['body_size', 'rating']) AS field_key, unnest([trim(string_split(value, '/')[1]), trim(string_split(value, '/')[2])]) AS piece
FROM v WHERE contains(value, '/')
"""
)
def q13_composite_split(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" / "), F.col("p_size").cast("int").cast("string")))
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("value_id"), F.lit("SIZE/RATING").alias("label"), value.alias("value"))
    return lookup.split_composites(values, RuleSet())


@query(
    """
SELECT p_partkey AS model_id, CASE WHEN s LIKE '667%' THEN 'EASTVALE' WHEN s LIKE '66%' OR s LIKE '65%' THEN 'NORTHGATE' WHEN s LIKE 'V1%' THEN 'EASTVALE' END AS maker
FROM (SELECT p_partkey, ['667-', '66', '657 ', 'v-1', 'X'][p_partkey % 5 + 1] || p_partkey AS m, upper(regexp_replace(m, '[^a-zA-Z0-9]', '', 'g')) AS s FROM part)
WHERE maker IS NOT NULL
"""
)
def q14_longest_prefix_maker(spark, sf_dir):
    key = F.col("p_partkey")
    model = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("667-", "66", "657 ", "v-1", "X")]), (key % 5 + 1).cast("int")), key.cast("string"))
    models = table(spark, sf_dir, "part").select(key.alias("model_id"), F.lit("actuator").alias("kind"), model.alias("model"))
    return lookup.longest_prefix(models, RuleSet().prefixes(spark))


@query(
    """
WITH t AS (SELECT l_orderkey, l_linenumber, lpad(CAST(l_suppkey % 90 + 1 AS VARCHAR), 2, '0') AS u, lpad(CAST(l_partkey % 900 + 100 AS VARCHAR), 3, '0') AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'B' ELSE 'A' END || CAST(u AS INT) || 'FV' || n || CASE l_linenumber % 3 WHEN 2 THEN 'A' ELSE '' END AS tag FROM t
"""
)
def q15_tag_parse(spark, sf_dir):
    unit = F.lpad((F.col("l_suppkey") % 90 + 1).cast("string"), 2, "0")
    number = F.lpad((F.col("l_partkey") % 900 + 100).cast("string"), 3, "0")
    k = F.col("l_linenumber") % 3
    raw = F.when(k == 0, F.concat(F.lit("b-"), unit, F.lit(" fv-"), number)).when(k == 1, F.concat(unit, F.lit("-FV-"), number)).otherwise(F.concat(unit, F.lit("FV"), number, F.lit("A")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tags.parse_tag(raw)["key"].alias("tag"))


@query(
    """
WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS k, 'A' || (l_suppkey % 90 + 1) || 'FV' AS base, l_partkey % 900 + 100 AS n, (l_partkey % 900 + 100) % 800 + 101 AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN concat_ws(',', base || n, base || m) WHEN 1 THEN concat_ws(',', base || n || 'A', base || n || 'B')
  ELSE concat_ws(',', base || n || 'A', base || m || 'B', base || n || 'C') END AS tags FROM t
"""
)
def q16_tag_list_expand(spark, sf_dir):
    unit, n, k = F.lpad((F.col("l_suppkey") % 90 + 1).cast("string"), 2, "0"), F.col("l_partkey") % 900 + 100, F.col("l_linenumber") % 3
    first, second = n.cast("string"), (n % 800 + 101).cast("string")
    raw = (
        F.when(k == 0, F.concat(unit, F.lit("-FV-"), first, F.lit("/"), second, F.lit("/12")))
        .when(k == 1, F.concat(unit, F.lit("ＦＶ"), first, F.lit("A / B")))
        .otherwise(F.concat(unit, F.lit("-fv-"), first, F.lit("A/"), second, F.lit("B, C")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(tags.find_tags(raw), ",").alias("tags"))


NAME_SQL = """
WITH n AS (SELECT p_partkey, ['DATA SHEET', 'REPAIR REPORT', 'DRAWING', 'INSTRUMENT LIST', NULL][p_partkey % 5 + 1] AS doc_kind,
  [true, true, false, false, NULL][p_partkey % 5 + 1] AS in_scope, CAST(p_size AS INT) AS revision, 'pdf' AS extension, 'A10FV' || (p_partkey % 900 + 100) AS tag FROM part) """


def _names(spark, sf_dir):
    """File names as people type them."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Data Sheeet", "REPIAR Report", "General Drawing", "Insturment List", "AB Letter")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("in/10FV"), (F.col("p_partkey") % 900 + 100).cast("string"), F.lit("-"), kind, F.lit("_Rev."), F.col("p_size").cast("int").cast("string"), F.lit(".PDF"))
    return table(spark, sf_dir, "part").select("p_partkey", tags.parse_filename(name).alias("got"))


@query(NAME_SQL + "SELECT * FROM n")
def q17_filename_classify(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", *[F.col("got")[c].alias(c) for c in ("doc_kind", "in_scope", "revision", "extension", "tag")])


@query(
    NAME_SQL
    + """SELECT p_partkey, CASE WHEN in_scope = false THEN doc_kind || ': no table of specifications' ELSE '' END AS out_of_scope,
  CASE WHEN doc_kind = 'REPAIR REPORT' THEN doc_kind || ': fields may be empty, what can''t be read is N/A' ELSE '' END AS caution FROM n"""
)
def q17b_scope_notes(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", tags.scope_notes(F.col("got")).alias("n")).select("p_partkey", "n.*")


@query(
    """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 4 = 2 AND day(o_orderdate) <= 12 THEN day(o_orderdate) ELSE month(o_orderdate) END AS INT) AS m,
  CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 4 = 2 AND day(o_orderdate) <= 12 THEN month(o_orderdate) ELSE day(o_orderdate) END AS INT) AS d,
  o_orderkey % 4 = 2 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders
"""
)
def q18_doc_date_parse(spark, sf_dir):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MMM d, yyyy")).when(k == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.concat(F.lit("issued "), F.translate(F.date_format(day, "yyyy"), "0123456789", "０１２３４５６７８９")))
    got = tags.parse_date(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[got[c].alias(c) for c in ("y", "m", "d", "ambiguous")])


def _candidates(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.lit(True).alias("is_spec"), (F.col("o_orderstatus") == "F").alias("superseded"),
        F.array(F.lit("A")).alias("tags"), F.struct(F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d")).alias("date_key"), (F.dayofmonth(day) <= 12).alias("date_ambiguous"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "RETROFIT").when(F.col("o_orderpriority") == "2-HIGH", "AS-BUILT").alias("mark"), F.lit(None).cast("string").alias("file_tag"),
    )


@query(
    """
WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderstatus = 'F' AS old, o_orderdate AS day, year(o_orderdate) AS y,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'RETROFIT' WHEN '2-HIGH' THEN 'AS-BUILT' END AS mark FROM orders),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT old) AS live, max(page) AS any_page, max(page) FILTER (NOT old) AS live_page, max(y) FILTER (NOT old) AS top FROM c GROUP BY doc_id),
w AS (SELECT c.doc_id, count(*) AS k, max(page) AS one, bool_or(day(day) <= 12) AS unsure, max(day) AS last FROM c JOIN a USING (doc_id) WHERE NOT old AND y = top GROUP BY c.doc_id),
b AS (SELECT c.doc_id, count(*) AS k, max(page) AS one FROM c JOIN w USING (doc_id) WHERE NOT old AND day = last GROUP BY c.doc_id),
m AS (SELECT c.doc_id, count(*) FILTER (mark = 'AS-BUILT') AS ab, max(page) FILTER (mark = 'AS-BUILT') AS ab_page,
    count(*) FILTER (mark = 'RETROFIT') AS rf, max(page) FILTER (mark = 'RETROFIT') AS rf_page FROM c JOIN a USING (doc_id) WHERE NOT old AND y = top GROUP BY c.doc_id)
SELECT a.doc_id,
  CASE WHEN n = 1 THEN any_page WHEN live = 0 THEN NULL WHEN live = 1 THEN live_page WHEN w.k = 1 THEN w.one
    WHEN NOT unsure AND b.k = 1 THEN b.one WHEN ab = 1 THEN ab_page WHEN rf = 1 THEN rf_page END AS page,
  CASE WHEN n = 1 THEN 'ONE_SPEC' WHEN live = 0 THEN 'ALL_SUPERSEDED' WHEN live = 1 THEN 'ONE_LIVE' WHEN w.k = 1 THEN 'LATEST_YEAR'
    WHEN NOT unsure AND b.k = 1 THEN 'LATEST_DATE' WHEN ab = 1 THEN 'AS-BUILT' WHEN rf = 1 THEN 'RETROFIT' ELSE 'UNDECIDED' END AS rule
FROM a LEFT JOIN w USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
)
def q19_latest_page_pick(spark, sf_dir):
    return triage.pick_latest(_candidates(spark, sf_dir))


PAGE_SQL = r"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations),
t AS (SELECT *, length(regexp_replace(coalesce(text, ''), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')) >= 100 AS layer FROM p) """


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


@query(
    PAGE_SQL
    + """, g AS (SELECT doc_id, bool_or(doc_id % 3 = 0) AS fine, max(page) FILTER (doc_id % 2 = 0) AS picked, count(*) FILTER (page = 1 OR page = 2) AS specs FROM t GROUP BY doc_id)
SELECT t.doc_id, page, CASE WHEN NOT fine THEN NULL WHEN t.doc_id % 5 = 0 THEN 'excel' ELSE 'vlm' END AS parser, specs > 1 AND picked IS NULL AS declined, layer AS text_hint
FROM t JOIN g ON t.doc_id = g.doc_id WHERE picked IS NULL OR picked = page"""
)
def q20_route_units(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumns({"is_spec": F.col("page") <= 2, "extension": F.when(F.col("doc_id") % 5 == 0, "xlsx").otherwise("pdf")})
    picked = pages.groupBy("doc_id").agg(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("page"))).alias("page")).withColumn("document_class", F.when(F.col("doc_id") % 3 == 0, "datasheet").otherwise("unsupported"))
    return triage.route(picked, pages)


@query(
    PAGE_SQL
    + """SELECT doc_id, count(*) AS page_count, count(*) FILTER (layer) AS text_pages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS text_len,
  CAST(max(length(coalesce(text, ''))) AS BIGINT) AS max_text_len, array_to_string(list_sort(list(page))[1:20], ',') AS first_pages,
  count(*) FILTER (layer) > 0 AND count(*) FILTER (layer) < count(*) AS mixed FROM t GROUP BY doc_id"""
)
def q21_probe_structure(spark, sf_dir):
    got = triage.probe_structure(_pages(spark, sf_dir))
    return got.withColumn("first_pages", F.array_join(F.col("first_pages").cast("array<string>"), ",")).withColumn("max_text_len", F.col("max_text_len").cast("long"))


PATH_SQL = """
WITH v AS (SELECT p_partkey AS doc_id, 'f1' AS field_key, CASE WHEN p_partkey % 11 = 0 THEN 'N/A' ELSE p_type END AS value FROM part WHERE p_partkey % 7 <> 0),
x AS (SELECT p_partkey AS doc_id, 'f1' AS field_key, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) || '.' WHEN 1 THEN p_type WHEN 2 THEN p_type || ' 7' ELSE '-' END AS value FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT coalesce(v.doc_id, x.doc_id) AS doc_id, nullif(v.value, 'N/A') AS vlm_value, nullif(x.value, '-') AS text_value FROM v FULL JOIN x ON v.doc_id = x.doc_id AND v.field_key = x.field_key),
s AS (SELECT *, CASE WHEN vlm_value IS NULL AND text_value IS NULL THEN 'NEITHER' WHEN text_value IS NULL THEN 'VLM_ONLY' WHEN vlm_value IS NULL THEN 'TEXT_ONLY'
  WHEN text_value LIKE '% 7' THEN 'CONFLICT' ELSE 'AGREE' END AS state FROM j) """


def _paths(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.col("p_type")
    vlm = part.where(k % 7 != 0).select(k.alias("doc_id"), F.lit("f1").alias("field_key"), F.when(k % 11 == 0, "N/A").otherwise(kind).alias("value"), F.lit("Type").alias("label"), F.lit(1).alias("page"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("note"))
    other = F.when(k % 4 == 0, F.concat(F.lower(kind), F.lit("."))).when(k % 4 == 1, kind).when(k % 4 == 2, F.concat(kind, F.lit(" 7"))).otherwise("-")
    read = part.where(k % 5 != 0).select(k.alias("doc_id"), F.lit("f1").alias("field_key"), other.alias("value"), F.lit("TYPE").alias("label"), F.lit(2).alias("page"))
    wanted = spark.sql("select 'f1' as field_key, cast(null as boolean) as numeric")
    return vlm, read, crosscheck.crosscheck(vlm, read, wanted)


@query(
    """
WITH v AS (SELECT s_suppkey AS doc_id, ['Fail-Close', 'FAIL CLOSE', 'valve open.', '３００', 'N／Ａ', 'XII'][s_suppkey % 6 + 1] AS vlm_value,
  ['VALVE CLOSE', 'CLOSE', 'FAIL-OPEN', '300', '12', '12'][s_suppkey % 6 + 1] AS text_value FROM supplier)
SELECT doc_id, 'action' AS field_key, vlm_value, text_value, CASE WHEN doc_id % 6 IN (1, 4) THEN 'CONFLICT' ELSE 'AGREE' END AS state FROM v
"""
)
def q22b_crosscheck_aliases(spark, sf_dir):
    """Aliases by label without punctuation, full-width forms and roman numbers; a full-width N/A is no empty reading, but none of the values agrees with it."""
    k = (F.col("s_suppkey") % 6 + 1).cast("int")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), k)
    side = lambda value: table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("action").alias("field_key"), value.alias("value"))
    wanted = spark.sql("select 'action' as field_key, cast(null as boolean) as numeric")
    aliases = spark.sql("select * from values ('action', 'VALVE CLOSE', 'FAIL CLOSE', 1), ('action', 'VALVE OPEN', 'FAIL OPEN', 2) as t(field_key, raw, to, ord)")
    return crosscheck.crosscheck(side(pick("Fail-Close", "FAIL CLOSE", "valve open.", "３００", "N／Ａ", "XII")), side(pick("VALVE CLOSE", "CLOSE", "FAIL-OPEN", "300", "12", "12")), wanted, aliases)


@query(PATH_SQL + "SELECT doc_id, 'f1' AS field_key, vlm_value, text_value, state FROM s")
def q22_crosscheck_full_outer(spark, sf_dir):
    return _paths(spark, sf_dir)[2]


@query(
    PATH_SQL
    + """SELECT count(*) FILTER (state = 'AGREE') AS agree, count(*) FILTER (state = 'NOTATION') AS notation, count(*) FILTER (state = 'CONFLICT') AS conflict,
  count(*) FILTER (state = 'VLM_ONLY') AS vlm_only, count(*) FILTER (state = 'TEXT_ONLY') AS text_only, count(*) FILTER (state = 'NEITHER') AS neither,
  count(*) FILTER (state = 'AGREE') / count(*) FILTER (state IN ('AGREE', 'CONFLICT')) AS rate FROM s"""
)
def q23_agreement_rate(spark, sf_dir):
    return crosscheck.agreement(_paths(spark, sf_dir)[2])


@query(
    PATH_SQL
    + """SELECT s.doc_id, 'f1' AS field_key, CASE WHEN state = 'TEXT_ONLY' THEN text_value ELSE vlm_value END AS value,
  CASE WHEN state = 'TEXT_ONLY' THEN 'TYPE' WHEN v.doc_id IS NOT NULL THEN 'Type' END AS label, CAST(CASE WHEN state = 'TEXT_ONLY' THEN 2 WHEN v.doc_id IS NOT NULL THEN 1 END AS INT) AS page,
  CAST(CASE WHEN state IN ('CONFLICT', 'TEXT_ONLY') THEN 0 WHEN v.doc_id IS NOT NULL THEN 0.9 END AS DOUBLE) AS confidence, state AS note FROM s LEFT JOIN v ON v.doc_id = s.doc_id"""
)
def q24_dual_merge(spark, sf_dir):
    return crosscheck.merge(*_paths(spark, sf_dir))


GOLD_SQL = """
WITH g AS (
  SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS field_key, l_shipmode AS cls, CASE WHEN l_tax = 0 THEN 'N/A' ELSE l_shipinstruct END AS truth,
    CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN lower(l_shipinstruct) ELSE l_shipmode END AS got,
    CASE WHEN l_linestatus = 'F' THEN 'NONE' ELSE l_shipinstruct END AS raw, l_linenumber AS page, CASE WHEN l_discount = 0.1 THEN 9 END AS got_page
  FROM lineitem
), k AS (SELECT *, upper(regexp_replace(truth, '[^A-Za-z0-9]', '', 'g')) AS nt, upper(regexp_replace(got, '[^A-Za-z0-9]', '', 'g')) AS ng, upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS nr FROM g),
sc AS (
  SELECT *, CASE WHEN got_page IS NOT NULL THEN 'WRONG_PAGE' WHEN truth = 'N/A' THEN CASE WHEN got IS NULL THEN 'EXACT' ELSE 'FABRICATED' END
      WHEN got IS NULL THEN 'MISSING' WHEN upper(got) = 'NONE' THEN CASE WHEN upper(raw) <> 'NONE' AND nr = nt THEN 'EXACT' ELSE 'WRONG' END
      WHEN ng = nt THEN 'EXACT' WHEN upper(raw) <> 'NONE' AND nr = nt THEN 'EXACT'
      WHEN contains(nt, nr) OR contains(nt, ng) THEN 'PENDING_NORM' ELSE 'WRONG' END AS verdict
  FROM k
), scored AS (SELECT *, verdict = 'EXACT' AND nt = coalesce(ng, '') AS strict FROM sc) """


def _scored(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    keys = F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key")
    truths = line.select(*keys, F.col("l_shipmode").alias("cls"), F.when(F.col("l_tax") == 0, "N/A").otherwise(F.col("l_shipinstruct")).alias("truth"), F.col("l_linenumber").alias("page"), F.lit(None).cast("boolean").alias("numeric"))
    got = F.when(F.col("l_returnflag") == "A", F.lit(None)).when(F.col("l_returnflag") == "N", F.lower("l_shipinstruct")).otherwise(F.col("l_shipmode"))
    values = line.select(*keys, got.alias("got"), F.when(F.col("l_linestatus") == "F", "NONE").otherwise(F.col("l_shipinstruct")).alias("raw"), F.when(F.col("l_discount") == 0.1, 9).alias("page"))
    return evaluate.score(truths, values)


@query(GOLD_SQL + "SELECT verdict, count(*) AS n, count(*) FILTER (strict) AS strict FROM scored GROUP BY verdict")
def q25_judge_cells(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("strict").alias("strict"))


@query(
    GOLD_SQL
    + """SELECT cls, count(*) AS cells, round_even(100 * count(*) FILTER (verdict = 'EXACT') / count(*), 0) AS lenient,
  round_even(100 * count(*) FILTER (verdict = 'EXACT' AND truth <> 'N/A') / count(*) FILTER (truth <> 'N/A'), 0) AS value_only,
  round_even(100 * count(*) FILTER (strict) / count(*), 0) AS strict, count(*) FILTER (verdict = 'EXACT' AND truth = 'N/A') AS none_matched FROM scored GROUP BY cls"""
)
def q26_accuracy_lenient_value_strict(spark, sf_dir):
    return evaluate.accuracy(_scored(spark, sf_dir), "cls")


@query(
    GOLD_SQL
    + """SELECT cls, field_key, CAST(CASE WHEN cls IS NULL THEN 2 ELSE 0 END + CASE WHEN field_key IS NULL THEN 1 ELSE 0 END AS BIGINT) AS grouping, count(*) AS cells, count(*) FILTER (verdict = 'EXACT') AS exact
  FROM scored GROUP BY GROUPING SETS ((cls), (field_key), ())"""
)
def q27_accuracy_grouping_sets(spark, sf_dir):
    return evaluate.accuracy_by_axes(_scored(spark, sf_dir), ["cls", "field_key"])


@query(
    GOLD_SQL
    + """, c AS (SELECT field_key, verdict, count(*) AS n, list_position(['FABRICATED', 'WRONG', 'WRONG_PAGE', 'MISSING', 'PENDING_NORM', 'EXACT'], verdict) AS r FROM scored GROUP BY ALL)
SELECT field_key, CAST(sum(n) AS BIGINT) AS cells, CAST(coalesce(sum(n) FILTER (verdict = 'EXACT'), 0) AS BIGINT) AS exact, arg_max(verdict, (n, -r)) FILTER (verdict <> 'EXACT') AS failure,
  coalesce(sum(n) FILTER (verdict = 'EXACT'), 0) / sum(n) AS accuracy FROM c GROUP BY field_key ORDER BY accuracy, field_key LIMIT 5"""
)
def q28_weak_fields_topk(spark, sf_dir):
    return evaluate.weak_fields(_scored(spark, sf_dir), 5)


@query(
    GOLD_SQL
    + """, b AS (SELECT doc_id, field_key FROM scored WHERE verdict IN ('FABRICATED', 'WRONG', 'PENDING_NORM')),
f AS (SELECT doc_id, field_key, CASE WHEN page % 2 = 0 THEN 'VOCAB' ELSE 'CONFIDENCE' END AS source FROM g WHERE cls IN ('AIR', 'RAIL')),
e AS (SELECT * FROM f UNION SELECT doc_id, field_key, 'ALL' FROM f)
SELECT source, count(*) AS flagged, count(b.doc_id) AS hits, (SELECT count(*) FROM b) AS bad, count(b.doc_id) / count(*) AS precision, count(b.doc_id) / (SELECT count(*) FROM b) AS recall
FROM e LEFT JOIN b ON e.doc_id = b.doc_id AND e.field_key = b.field_key GROUP BY source"""
)
def q29_flag_precision_recall(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    flags = scored.where(F.col("cls").isin("AIR", "RAIL")).select("doc_id", "field_key", F.when(F.col("page") % 2 == 0, "VOCAB").otherwise("CONFIDENCE").alias("source"))
    return evaluate.flag_quality(flags, scored)


@query(
    GOLD_SQL
    + """SELECT field_key, count(*) AS dangerous, count(*) FILTER (cls NOT IN ('AIR', 'RAIL')) AS missed FROM scored WHERE verdict IN ('FABRICATED', 'WRONG', 'PENDING_NORM') GROUP BY field_key"""
)
def q29b_missed_by_field(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return evaluate.missed_by_field(scored.where(F.col("cls").isin("AIR", "RAIL")).select("doc_id", "field_key", F.lit("VOCAB").alias("source")), scored)


@query(
    """
SELECT s_suppkey AS doc_id, ['EXACT', 'EXACT', 'EXACT', 'WRONG', 'EXACT', 'FABRICATED'][s_suppkey % 6 + 1] AS verdict FROM supplier
"""
)
def q25b_judge_compatible_forms(spark, sf_dir):
    """Full-width, superscript and roman readings."""
    k = (F.col("s_suppkey") % 6 + 1).cast("int")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), k)
    keys = F.col("s_suppkey").alias("doc_id"), F.lit("f").alias("field_key")
    truths = table(spark, sf_dir, "supplier").select(*keys, pick("300 m³/h", "N/A", "CLASS IV", "300", "12 mm", "n/a").alias("truth"), F.lit(1).alias("page"), F.lit(None).cast("boolean").alias("numeric"))
    values = table(spark, sf_dir, "supplier").select(*keys, pick("３００", "Ｎ／Ａ", "ｃｌａｓｓ 4", "３０１", "12 ㎜", "？１２").alias("got"), F.lit(None).cast("string").alias("raw"), F.lit(1).alias("page"))
    return evaluate.score(truths, values).select("doc_id", "verdict")


@query(
    """
WITH r AS (SELECT l_orderkey AS doc_id, 'f' || (l_linenumber % 2) AS field_key, CASE WHEN l_linenumber % 3 = 0 THEN lower(l_shipinstruct) ELSE l_shipinstruct END AS value, l_shipmode AS label, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
k AS (SELECT *, upper(replace(value, ' ', '')) AS norm FROM r),
l AS (SELECT field_key, norm, label, min(seq) AS s FROM k GROUP BY ALL),
d AS (SELECT field_key, norm, doc_id, min(seq) AS s FROM k GROUP BY ALL)
SELECT field_key, arg_min(value, seq) AS value, count(*) AS n, count(DISTINCT doc_id) AS docs,
  (SELECT array_to_string(list(doc_id ORDER BY s)[1:6], ',') FROM d WHERE d.field_key = k.field_key AND d.norm = k.norm) AS first_docs,
  (SELECT array_to_string(list(label ORDER BY s)[1:3], ',') FROM l WHERE l.field_key = k.field_key AND l.norm = k.norm) AS first_labels
FROM k GROUP BY field_key, norm
"""
)
def q30_vocab_candidates(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.lower("l_shipinstruct")).otherwise(F.col("l_shipinstruct"))
    rows = line.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("field_key"), value.alias("value"), F.col("l_shipmode").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    got = vocabulary.candidates(rows)
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("first_docs", "first_labels")})


@query()
def q31_nearest_value(spark, sf_dir):
    values = table(spark, sf_dir, "part").select(F.col("p_type").alias("value"))
    return vocabulary.nearest(values, ["STANDARD GRADE", "ECONOMIC", "PROMOTION"]).groupBy("value", "nearest").agg(F.count("*").alias("n"))


@query(
    """
WITH r AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS field_key, CASE l_shipmode WHEN 'AIR' THEN 'Logo' WHEN 'RAIL' THEN 'Maker' ELSE 'Text' END AS label, 1 - l_discount AS c, l_shipmode AS value FROM lineitem),
s AS (SELECT DISTINCT doc_id FROM r WHERE label = 'Maker')
SELECT 'CONFIDENCE' AS source, count(*) AS n FROM r WHERE c < 0.95
UNION ALL SELECT 'VOCAB', count(*) FROM r WHERE field_key = 'f1' AND value NOT IN ('AIR', 'RAIL')
UNION ALL SELECT 'PROVENANCE', count(*) FROM r JOIN s ON r.doc_id = s.doc_id WHERE label = 'Logo'
"""
)
def q32_provenance_self_join(spark, sf_dir):
    label = F.when(F.col("l_shipmode") == "AIR", "Logo").when(F.col("l_shipmode") == "RAIL", "Maker").otherwise("Text")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), label.alias("raw_label"), (1 - F.col("l_discount")).alias("confidence"), F.lit(0.95).alias("threshold"), F.col("l_shipmode").alias("value"))
    known = spark.sql("select * from values ('f1', 'AIR'), ('f1', 'RAIL') as t(field_key, value)")
    return vocabulary.flags(rows, known).groupBy("source").agg(F.count("*").alias("n"))


@query(
    """
SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'Flow Control Valve' WHEN 1 THEN 'Hand Valve' WHEN 2 THEN 'Level Control Valve' END AS value,
  CASE WHEN s_suppkey % 4 = 3 THEN 'na' ELSE 'review' END AS state FROM supplier
"""
)
def q33_derived_second_pass(spark, sf_dir):
    k = F.col("s_suppkey")
    tag = F.concat(F.lit("10-"), F.element_at(F.array(*[F.lit(x) for x in ("FV", "HV", "LV", "ZZ")]), (k % 4 + 1).cast("int")), F.lit("-"), F.lpad((k % 900 + 100).cast("string"), 3, "0"))
    docs = table(spark, sf_dir, "supplier").select(k.alias("doc_id"))
    found = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.lit("tag").alias("field_key"), tag.alias("raw_value"), F.lit("Tag No").alias("raw_label"), F.lit(0.99).alias("confidence"), F.lit(None).cast("string").alias("note"))
    return resolve.resolve(found, docs).where("field_key = 'type_name'").select("doc_id", "value", "state")


@query("SELECT o_orderkey AS doc_id, count(l_orderkey) AS fields, CASE WHEN count(l_orderkey) = 0 THEN 'NOT_STORED' END AS error FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_shipmode = 'AIR') ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q34_replay_join(spark, sf_dir):
    stored = lines(spark, sf_dir).where("raw_label = 'AIR'")
    got = resolve.replay(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), stored)
    return got.groupBy("doc_id").agg(F.count("field_key").alias("fields"), F.max("error").alias("error"))


RUNS_SQL = (
    GOLD_SQL
    + """, a AS (SELECT doc_id, field_key, CASE WHEN cls = 'AIR' THEN 'EXACT' WHEN cls = 'MAIL' THEN 'MISSING' ELSE verdict END AS verdict FROM scored),
t AS (SELECT s.field_key, s.verdict AS b, a.verdict AS a FROM scored s JOIN a ON s.doc_id = a.doc_id AND s.field_key = a.field_key) """
)
RANK_SQL = "list_position(['FABRICATED', 'WRONG', 'WRONG_PAGE', 'MISSING', 'PENDING_NORM', 'EXACT'], {})"


def _runs(spark, sf_dir):
    before = stored(_scored(spark, sf_dir).select("doc_id", "field_key", "cls", "verdict"), "scored")  # judged once, as both runs read it
    return before, before.withColumn("verdict", F.when(F.col("cls") == "AIR", "EXACT").when(F.col("cls") == "MAIL", "MISSING").otherwise(F.col("verdict")))


@query(RUNS_SQL + "SELECT b AS before, a AS after, count(*) AS n FROM t GROUP BY ALL")
def q35_run_transition_matrix(spark, sf_dir):
    return evaluate.transitions(*_runs(spark, sf_dir))


@query(
    RUNS_SQL
    + f""", p AS (SELECT field_key, count(*) FILTER ({RANK_SQL.format("a")} > {RANK_SQL.format("b")}) AS better, count(*) FILTER ({RANK_SQL.format("a")} < {RANK_SQL.format("b")}) AS worse FROM t GROUP BY field_key),
r AS (SELECT *, better - worse AS net, CAST(row_number() OVER (ORDER BY abs(better - worse) DESC, field_key) AS INT) AS rank FROM p)
SELECT *, (SELECT sum(abs(net)) FILTER (rank <= 3) / sum(abs(net)) FROM r) AS top3_share FROM r"""
)
def q35b_net_by_field(spark, sf_dir):
    return evaluate.net_by_field(*_runs(spark, sf_dir))


REPS_SQL = """
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS field_key, i AS rep, (l_partkey + i * l_suppkey) % 4 <> 0 AS ok, CAST((l_partkey * i + l_suppkey) % 3 AS INT) AS v FROM lineitem, range(1, 4) t(i)) """


def _reps(spark, sf_dir):
    rep = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rep.alias("rep"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field_key"), "rep", ((F.col("l_partkey") + F.col("rep") * F.col("l_suppkey")) % 4 != 0).alias("ok"), F.col("l_partkey"), F.col("l_suppkey"))


@query(REPS_SQL + ", c AS (SELECT doc_id, field_key, bool_and(ok) AS e, bool_or(ok) AS s FROM r GROUP BY ALL) SELECT count(*) FILTER (e) AS always, count(*) FILTER (NOT s) AS never, count(*) FILTER (s AND NOT e) AS flip FROM c")
def q36_stability(spark, sf_dir):
    return evaluate.stability(_reps(spark, sf_dir))


@query(
    """
WITH r AS (SELECT l_orderkey AS d, l_linenumber AS f, i AS v, (l_partkey * i + l_suppkey) % (i + 2) <> 0 AS ok FROM lineitem, range(1, 4) t(i)),
p AS (SELECT a.v AS first, b.v AS second, count(*) FILTER (a.ok AND NOT b.ok) AS first_only, count(*) FILTER (NOT a.ok AND b.ok) AS second_only FROM r a JOIN r b ON a.d = b.d AND a.f = b.f AND a.v < b.v GROUP BY ALL),
z AS (SELECT *, abs(first_only - second_only) / sqrt(first_only + second_only) AS z FROM p)
SELECT CAST(first AS INT) AS first, CAST(second AS INT) AS second, first_only, second_only, z,
  CASE WHEN first_only + second_only < 10 THEN 'hold' WHEN z >= 2.58 THEN 'strong' WHEN z >= 1.96 THEN 'win' ELSE 'even' END AS decision FROM z
"""
)
def q37_sign_test(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("variant", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    ok = (F.col("l_partkey") * F.col("variant") + F.col("l_suppkey")) % (F.col("variant") + 2) != 0
    return evaluate.sign_test(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field_key"), F.lit(1).alias("rep"), "variant", ok.alias("ok")))


@query("SELECT fmt, file FROM (SELECT p_brand AS fmt, p_name || p_partkey AS file, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_name || p_partkey), p_name || p_partkey) AS r FROM part) WHERE r <= 3")
def q38_quota_sample_by_hash(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("fmt"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"))
    quotas = files.select("fmt").distinct().withColumn("quota", F.lit(3))
    return evaluate.quota_sample(files, quotas).select("fmt", "file")


@query("SELECT upper(replace(p_name, ' ', '')) AS norm, count(*) AS n, count(DISTINCT p_brand) AS files, min(p_name) AS label FROM part GROUP BY 1")
def q39_unmapped_label_stats(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("label"))
    return vocabulary.label_stats(labels, RuleSet().labels(spark))


@query("SELECT c_custkey AS doc_id, unnest(['name', 'segment', 'nation']) AS field_key, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS truth FROM customer")
def q40_unpivot_gold(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return wide.unpivot("doc_id", ["name", "segment", "nation"], "field_key", "truth")


@query(
    """
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, l_shipmode AS value, l_returnflag AS state FROM lineitem)
SELECT doc_id, 'value' AS attribute, max(value) FILTER (k = 1) AS f1, max(value) FILTER (k = 2) AS f2 FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, 'state', max(state) FILTER (k = 1), max(state) FILTER (k = 2) FROM r GROUP BY doc_id
"""
)
def q41_pivot_export(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), F.col("l_shipmode").alias("value"), F.col("l_returnflag").alias("state"))
    return export_table(rows, ["f1", "f2"], ["value", "state"])


ALL_FIELDS = [f"f{k}" for k in range(1, 8)]


@query(
    "".join(
        f"{'' if a == 'value' else ' UNION ALL '}SELECT l_orderkey AS doc_id, '{a}' AS attribute, " + ", ".join(f"max({c}) FILTER (l_linenumber = {f[1:]}) AS {f}" for f in ALL_FIELDS) + " FROM lineitem GROUP BY l_orderkey"
        for a, c in (("value", "l_shipmode"), ("state", "l_returnflag"))
    )
)
def q41b_pivot_export_all(spark, sf_dir):
    """The export of q41 with all fields."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), F.col("l_shipmode").alias("value"), F.col("l_returnflag").alias("state"))
    return export_table(rows, ALL_FIELDS, ["value", "state"])


@query(
    """
SELECT p_partkey, round(CAST(p_size AS DOUBLE) * 2 + 10, 6) AS x0, round(5 + CAST(p_size AS DOUBLE) * 3, 6) AS y0, round(CAST(p_size + 4 AS DOUBLE) * 2 + 10, 6) AS x1, round(5 + CAST(p_size + 8 AS DOUBLE) * 3, 6) AS y1 FROM part
"""
)
def q42_bbox_affine(spark, sf_dir):
    m = geometry.matrix(*[F.lit(x) for x in (2.0, 0.0, 10.0, 0.0, 3.0, 5.0)])
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", geometry.box(size, size, size + 4, size + 8).alias("own"), m.alias("m"))
    # out and back again is the box itself, so the shown box has been through both
    rows = rows.withColumn("inverse", geometry.invert(F.col("m"))).withColumn("there", geometry.map_box(F.col("m"), F.col("own")))
    rows = rows.withColumn("back", geometry.map_box(F.col("inverse"), F.col("there"))).withColumn("shown", geometry.map_box(F.col("m"), F.col("back")))
    return rows.select("p_partkey", *[F.round(F.col("shown")[c], 6).alias(c) for c in geometry.CORNERS])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(1.156 * l_quantity * sqrt(1 / l_discount), 6) END AS cv FROM lineitem")
def q43_cv_liquid(spark, sf_dir):
    cv = text.flow_coefficient(F.col("l_quantity"), F.lit(1.0), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(cv, 6).alias("cv"))


def _as_log(events):
    return events.select(F.col("event_id").cast("double").alias("ts"), F.col("event_type").alias("event"), F.lit("run").alias("run_id"), F.col("user_id").cast("string").alias("doc_id"), F.col("props").alias("payload"))


@query("SELECT 'run' AS run_id, event_type AS counter, count(*) AS n FROM events GROUP BY event_type")
def q44_event_counters(spark, sf_dir):
    return stream.counters(_as_log(table(spark, sf_dir, "events")))


def _stream(spark, sf_dir, aggregate, name):
    """An aggregate by a stream over the files of the events, read until none is left."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="docsift-")
    name = f"{name}_{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.drain(aggregate(source), name, f"{folder}/{name}")


@query("SELECT 'run' AS run_id, event_type AS counter, count(*) AS n FROM events GROUP BY event_type")
def q45_events_stream_equals_batch(spark, sf_dir):
    """The counters by a stream over the log's files."""
    return _stream(spark, sf_dir, lambda source: stream.counters(_as_log(source)), "counters")


def _skipped(spark, sf_dir):
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "no page (scan)").otherwise(F.concat(F.lit("read error: "), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), reason.alias("reason"))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'no page' ELSE 'read error' END AS reason, count(*) AS docs, min(o_orderkey) AS first_doc FROM orders GROUP BY 1")
def q46_unscored_reasons(spark, sf_dir):
    return evaluate.unscored_reasons(_skipped(spark, sf_dir))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'no page' ELSE 'read error' END AS reason, count(*) OVER (PARTITION BY o_orderpriority = '1-URGENT') AS docs, o_orderkey AS doc_id FROM orders")
def q46b_unscored_documents(spark, sf_dir):
    """The documents of the reasons of q46, a row each."""
    return evaluate.unscored_documents(_skipped(spark, sf_dir))


@query(RUNS_SQL + f"SELECT count(*) FILTER ({RANK_SQL.format('a')} > {RANK_SQL.format('b')}) AS better, count(*) FILTER ({RANK_SQL.format('a')} < {RANK_SQL.format('b')}) AS worse, count(*) FILTER (a = b) AS same, count(*) FILTER ({RANK_SQL.format('a')} > {RANK_SQL.format('b')}) - count(*) FILTER ({RANK_SQL.format('a')} < {RANK_SQL.format('b')}) AS net FROM t")
def q47_escalation_effect(spark, sf_dir):
    before, after = _runs(spark, sf_dir)
    moved = before.select("doc_id", "field_key", F.col("verdict").alias("before")).join(after.select("doc_id", "field_key", F.col("verdict").alias("after")), ["doc_id", "field_key"])
    return evaluate.escalation_effect(moved)


@query("SELECT \"check\", count(*) AS n FROM (SELECT CASE WHEN r > 60 THEN 'suspect' WHEN r > 35 THEN 'warn' ELSE 'normal' END AS \"check\" FROM (SELECT p_retailprice / ((p_size + 1.5) * (p_size + 1.5)) AS r FROM part)) GROUP BY 1")
def q48_cv_plausibility(spark, sf_dir):
    size = F.concat(F.col("p_size").cast("int").cast("string"), F.lit("-1/2"))
    rows = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("cv"), (text.inches(size) + 1).alias("inches"))
    return evaluate.plausibility(rows).groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY event_type")
def q49_cost_by_model(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"))


@query(
    """
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS row, CAST(1 AS INT) AS col, CASE WHEN l_linenumber IN (1, 4) AND l_orderkey % 2 = 0 THEN 'Max' ELSE l_shipmode END AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CAST(2 + l_linenumber AS INT), CASE WHEN l_linenumber IN (1, 4) AND l_orderkey % 2 = 0 THEN 'Normal' ELSE l_returnflag END FROM lineitem),
h AS (SELECT doc_id, row, bool_or(value = 'Max') AS head, max(CASE WHEN value = 'Normal' THEN col END) AS nor FROM c GROUP BY doc_id, row)
SELECT doc_id, row, last_value(CASE WHEN head THEN nor END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM h
"""
)
def q50_header_carry_forward(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    head = F.col("l_linenumber").isin(1, 4) & (F.col("l_orderkey") % 2 == 0)
    place = F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row")
    cells = line.select(*place, F.lit(1).alias("col"), F.when(head, "Max").otherwise(F.col("l_shipmode")).alias("value")).unionByName(line.select(*place, (2 + F.col("l_linenumber")).cast("int").alias("col"), F.when(head, "Normal").otherwise(F.col("l_returnflag")).alias("value")))
    return lookup.carry_header(cells, ["doc_id"])


@query(
    """
SELECT field_key, label, count(*) AS n, count(DISTINCT doc_id) AS docs, label IN ('Nozzle', 'Tag No') AS collides FROM (
  SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'tag' ELSE 'model' END AS field_key,
    CASE l_shipmode WHEN 'AIR' THEN 'Tag No' WHEN 'MAIL' THEN 'Nozzle' WHEN 'RAIL' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Position Code' ELSE 'Type Code' END ELSE '' END AS label FROM lineitem)
WHERE label <> '' AND NOT (label = 'Tag No' AND field_key = 'tag') GROUP BY ALL
"""
)
def q51_label_candidates(spark, sf_dir):
    mode, even = F.col("l_shipmode"), F.col("l_linenumber") % 2 == 0
    label = F.when(mode == "AIR", "Tag No").when(mode == "MAIL", "Nozzle").when(mode == "RAIL", F.when(even, "Position Code (as printed here)").otherwise("Type Code")).otherwise("")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(even, "tag").otherwise("model").alias("field_key"), label.alias("raw_label"))
    rules = RuleSet()
    return gold.label_candidates(rows, rules.labels(spark), rules.composites(spark))


@query(
    """
WITH a AS (SELECT o_orderkey AS doc_id, o_orderstatus AS truth FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS truth FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 'f' AS field_key, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  a.truth AS before, b.truth AS after FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.truth <> b.truth
"""
)
def q52_gold_changes(spark, sf_dir):
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    side = lambda n, truth: orders.where(k % n != 0).select(k.alias("doc_id"), F.lit("f").alias("field_key"), truth.alias("truth"))
    status = F.col("o_orderstatus")
    return gold.gold_changes(side(3, status), side(7, F.when(k % 5 == 0, "X").otherwise(status)))


@query(
    """
SELECT field_key, value, count(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'rating' ELSE 'maker' END AS field_key,
  CASE WHEN p_size % 2 = 0 THEN ['CLASS 150', 'cl 300', '450#'][p_partkey % 3 + 1] ELSE ['Northgate', 'WESTEND', 'EASTVALE'][p_partkey % 3 + 1] END AS value FROM part)
WHERE value IN ('450#', 'WESTEND') GROUP BY ALL
"""
)
def q53_unreachable_values(spark, sf_dir):
    even, k = F.col("p_size") % 2 == 0, (F.col("p_partkey") % 3 + 1).cast("int")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), k)
    rows = table(spark, sf_dir, "part").select(F.when(even, "rating").otherwise("maker").alias("field_key"), F.when(even, pick("CLASS 150", "cl 300", "450#")).otherwise(pick("Northgate", "WESTEND", "EASTVALE")).alias("truth"))
    rules = RuleSet()
    return gold.unreachable(rows, rules.vocabulary(spark), rules.aliases(spark))


@query(
    """
WITH r AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS field_key, 1 - l_discount AS c, CASE WHEN l_shipmode <> 'AIR' THEN l_shipmode END AS value, l_linenumber <= 2 AS required,
  CASE WHEN l_orderkey % 2 = 0 THEN ['MAIL', 'RAIL'] END AS tags FROM lineitem),
w AS (SELECT *, concat_ws(' | ', CASE WHEN c < 0.95 THEN 'LOW_CONFIDENCE' END, CASE WHEN required AND value IS NULL THEN 'MISSING' END,
  CASE WHEN field_key = 'f1' AND tags IS NOT NULL AND NOT list_contains(tags, value) THEN 'TAG_MISMATCH' END) AS why FROM r)
SELECT why, count(*) AS n FROM w WHERE why <> '' GROUP BY why
"""
)
def q54_escalation_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), (1 - F.col("l_discount")).alias("confidence"), F.lit(0.95).alias("threshold"),
        F.nullif(F.col("l_shipmode"), F.lit("AIR")).alias("value"), (F.col("l_linenumber") <= 2).alias("required"),
    )
    tagged = rows.select("doc_id").distinct().where("doc_id % 2 = 0").withColumn("tags", F.array(F.lit("MAIL"), F.lit("RAIL")))
    return gold.escalations(rows, tagged, "f1").groupBy("why").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size % 5 = 0 THEN 'regulator' ELSE 'valve' END AS cls, count(*) AS n FROM part GROUP BY 1")
def q55_equipment_class(spark, sf_dir):
    name = F.when(F.col("p_size") % 7 == 0, "  ").when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" self operated"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(gold.equipment_class(name).alias("cls")).agg(F.count("*").alias("n"))
