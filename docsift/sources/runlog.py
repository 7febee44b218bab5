"""Files around a run: its log and summary, records as JSON, the cache of answers, fixtures, and where documents are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.text import norm_label, strip
from docsift.streaming.events import counters, write_batch


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Events (ts, event, run_id, doc_id, payload) as JSON lines, beside those that are there.

    A batch of a name that is there already, as after a retry, replaces it;
    without a name it is a new one.
    """
    write_batch(events, path, batch or uuid.uuid4().hex)


def write_summary(events: DataFrame, path: str, manifest: dict[str, str]) -> None:
    """One JSON row for each run of the log: its counters, first and last event, and the manifest's entries."""
    told = counters(events).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "n")))).alias("counters"))
    span = events.groupBy("run_id").agg(F.min("ts").alias("started"), (F.max("ts") - F.min("ts")).alias("elapsed"))
    about = [F.lit(v).alias(k) for k, v in manifest.items()]
    told.join(span, "run_id").select("run_id", "started", "elapsed", "counters", *about).write.mode("append").json(path)


def record_rows(records: DataFrame) -> DataFrame:
    """(doc_id, field_key, row): each record as JSON, nulls included."""
    return records.select("doc_id", "field_key", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def new_answers(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (key, payload) that the cache lacks, one for each key, the smallest payload of equal keys."""
    return answers.groupBy("key").agg(F.min("payload").alias("payload")).join(cache.select("key"), "key", "left_anti")


def put_answers(spark: SparkSession, path: str, answers: DataFrame) -> None:
    """Add to the cache at ``path`` what it lacks; an entry once written stays."""
    spark.createDataFrame([], "key string, payload string").write.mode("append").json(path)  # so that there is a folder
    there = spark.read.schema("key string, payload string").option("recursiveFileLookup", "true").json(path)
    new_answers(there, answers).write.mode("append").json(path)


def sized_key(content_hash: Column, page: Column, size: Column, rep: Column) -> Column:
    """A key for one page at one size and repetition, so that none of them collide."""
    return F.sha2(F.concat_ws("\x1f", content_hash, page.cast("string"), size.cast("string"), rep.cast("string")), 256)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    return files.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))


def locate(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path to rows (file) by the name in lower case; of equal names the first path. Null where there is none."""
    first = files.groupBy(F.lower("name").alias("name_")).agg(F.min("path").alias("path"))
    return rows.withColumn("name_", F.lower("file")).join(first, "name_", "left").drop("name_")


def approval_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file {summary, rows} of vocabulary candidates."""
    row = "struct<field_key:string,value:string,count:bigint,docs:array<string>,labels:array<string>,nearest:string,correctable:boolean,note:string>"
    found = spark.read.schema(f"rows array<{row}>").option("multiLine", "true").json(path)
    return found.select(F.inline("rows"))


def records_fixture(spark: SparkSession, path: str, fields: DataFrame) -> DataFrame:
    """Records of documents stored as {doc_id, fields: [{key, value, raw_value, ...}]}, with their fields' attributes.

    A key that no field has is an error, told with the keys (20 at most).
    """
    field = "struct<key:string,value:string,raw_value:string,raw_label:string,state:string,failure:string,note:string,confidence:double,page:int,source_locator:string>"
    found = spark.read.schema(f"doc_id string, fields array<{field}>").option("multiLine", "true").json(path)
    rows = found.select("doc_id", F.inline("fields")).withColumnRenamed("key", "field_key")
    unknown = [r[0] for r in rows.join(fields, "field_key", "left_anti").select("field_key").distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(map(str, unknown)))}")
    return rows.join(F.broadcast(fields), "field_key")


def gold_by_labels(cells: DataFrame, index: DataFrame, info: dict[int, str], value_head: str, first_col: int = 10) -> tuple[DataFrame, DataFrame]:
    """Long gold rows of a wide sheet, and its names that no field has.

    Field names stand in row 1 from ``first_col`` on and are carried right;
    of each field's columns the one headed ``value_head`` in row 2 counts.
    ``index`` is ``RuleSet.alias_index``. Rows without a file name (an entry of
    ``info``) are left out.
    """
    heads = cells.where(F.col("row").isin(1, 2) & (F.col("col") >= first_col)).groupBy("doc_id", "col").agg(*[F.max(F.when(F.col("row") == k, F.col("value"))).alias(n) for k, n in ((1, "name"), (2, "head"))])
    carried = F.last("name", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("col"))
    named = heads.withColumn("name", strip(carried)).where((F.col("head") == value_head) & (F.col("name") != "")).withColumn("norm", norm_label(F.col("name"))).join(index, "norm", "left")
    about = cells.where(F.col("row") > 2).groupBy("doc_id", "row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(n) for c, n in info.items()]).where(strip(F.col("file")) != "")
    known = named.where("field_key is not null").select("doc_id", "col", "field_key")
    values = cells.where(F.col("row") > 2).join(known, ["doc_id", "col"]).select("doc_id", "row", "field_key", F.col("value").alias("truth"), "is_string")
    return about.join(values, ["doc_id", "row"]), named.where("field_key is null").select("doc_id", "name")
