"""The event log as a stream: counters, last actions and vocabulary, in event order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import norm_alias

EVENT = "ts double, event string, run_id string, doc_id string, payload string"


def read_events(spark: SparkSession, path: str, *, stream: bool = True, per_trigger: int = 100) -> DataFrame:
    """JSON lines with one event each, of all batches below a folder; as a stream, new files are read as they come."""
    if stream:
        return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).json(path)
    return spark.read.schema(EVENT).option("recursiveFileLookup", "true").json(path)


def write_batch(rows: DataFrame, path: str, batch: str, form: str = "json") -> None:
    """One batch in a folder of its own, so that a batch that is written again replaces itself."""
    rows.write.mode("overwrite").format(form).save(f"{path}/batch-{batch}")


def write_stream(rows: DataFrame, path: str, checkpoint: str, form: str = "json", mode: str = "append") -> None:
    """Write a stream batch by batch until none is left; a batch that is repeated after a failure counts once."""
    sink = rows.writeStream.foreachBatch(lambda part, k: write_batch(part, path, f"{k:012d}", form)).outputMode(mode)
    sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counters(events: DataFrame) -> DataFrame:
    """Events by run and name, with changed retries, resolved states and escalations without a reason as counters of their own."""
    state = F.get_json_object("payload", "$.state")
    changed = F.get_json_object("payload", "$.changed") == "true"
    mute = (F.col("event") == "escalate") & (F.trim(F.coalesce(F.get_json_object("payload", "$.reason"), F.lit(""))) == "")
    names = F.array_compact(F.array(F.col("event"), F.when(mute, "escalate_without_reason"), F.when((F.col("event") == "retry") & changed, "retry_value_changed"), F.when((F.col("event") == "state_resolved") & state.isNotNull(), F.concat(F.lit("state:"), state))))
    return events.select("run_id", F.explode(names).alias("counter")).groupBy("run_id", "counter").agg(F.count("*").alias("n"))


def with_time(events: DataFrame, start: str, late: str = "10 minutes") -> DataFrame:
    """Event time from seconds since the run's start, with a watermark that bounds the state of windows."""
    return events.withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("ts"))).withWatermark("at", late)


def windowed(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    return events.groupBy(F.window("at", width), "event").agg(F.count("*").alias("n"))


def last_actions(events: DataFrame) -> DataFrame:
    """The last human action of each document and field."""
    action = events.where(F.col("event") == "human_action").select("doc_id", F.get_json_object("payload", "$.field").alias("field_key"), F.get_json_object("payload", "$.action").alias("action"), "ts")
    return action.groupBy("doc_id", "field_key").agg(F.max_by("action", "ts").alias("action"))


ACTION = "doc_id string, field_key string, action string, human_value string, ts double"


def revised_actions(events: DataFrame, start: str, late: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """The stream of changes of each document's and field's last human action, whatever order its events come in.

    An undone action is revised to null, a late one that isn't the last of its
    ``span`` of event time says nothing. State is a row for each document, field
    and span, kept by Spark's own aggregate and forgotten when the watermark,
    ``late`` behind the newest event, has passed the span's end. ``current``
    gives the state of what was sent.
    """
    get = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    now = F.unix_micros(F.current_timestamp())  # one value for each batch, and the same when the batch is repeated
    acted = with_time(events.where((F.col("event") == "human_action") & F.col("ts").isNotNull()), start, late).select("doc_id", get("field").alias("field_key"), get("action"), get("human_value"), "ts", "at", (-now).alias("earlier"))
    rank = [F.col("ts"), *[F.coalesce(c, F.lit("")).alias(f"{c}_rank") for c in ("action", "human_value")], F.col("earlier")]
    last = acted.groupBy(F.window("at", span), "doc_id", "field_key").agg(F.max(F.struct(*rank, "action", "human_value")).alias("a"))
    # an action that was already the last one bears the time of the batch that told it
    changed = last.where(F.col("a.earlier") == -now)
    return changed.select("doc_id", "field_key", F.nullif(F.col("a.action"), F.lit("undo")).alias("action"), F.when(F.col("a.action") == "override", F.col("a.human_value")).alias("human_value"), "a.ts")


def current(changes: DataFrame) -> DataFrame:
    """The last change of each document and field."""
    last = F.max_by(F.struct("action", "human_value"), F.struct("ts", F.coalesce("action", F.lit("~"))))
    return changes.groupBy("doc_id", "field_key").agg(last.alias("a")).select("doc_id", "field_key", "a.action", "a.human_value")


def vocabulary_queue(events: DataFrame) -> DataFrame:
    """Values that a stream of readings (ts, field_key, value) brings: n and the first spelling by normal form.

    The state holds a row for each field and normal form, not for each reading.
    """
    norm = norm_alias(F.col("value"), F.lit(True))
    return events.where(F.col("value").isNotNull()).groupBy("field_key", norm.alias("norm")).agg(F.count("*").alias("n"), F.min_by("value", F.struct("ts", "value")).alias("value"))


def stage_events(records: DataFrame, run_id: str) -> DataFrame:
    """The events of resolved records, from what the stages left in them: validation_failed, retry, state_resolved.

    Nothing is emitted from executors; ts is left null for the sink to fill.
    """
    has_retry = "retry_count" in records.columns
    failed = F.when(~F.col("failure").isin("NONE", "NO_EVIDENCE"), F.struct(F.lit("validation_failed").alias("event"), F.to_json(F.struct(F.col("field_key").alias("field"), F.col("failure").alias("kind"))).alias("payload")))
    again = F.when(F.col("retry_count") > 0, F.struct(F.lit("retry").alias("event"), F.to_json(F.struct(F.col("field_key").alias("field"), F.col("retry_changed").alias("changed"))).alias("payload"))) if has_retry else None
    state = F.struct(F.lit("state_resolved").alias("event"), F.to_json(F.struct(F.col("field_key").alias("field"), F.col("state"))).alias("payload"))
    told = F.array_compact(F.array(failed, *([again] if has_retry else []), state))
    return records.select(F.lit(None).cast("double").alias("ts"), F.col("doc_id").cast("string").alias("doc_id"), F.explode(told).alias("e")).select("ts", "e.event", F.lit(run_id).alias("run_id"), "doc_id", "e.payload")


def escalation_events(escalations: DataFrame, run_id: str) -> DataFrame:
    """An event ``escalate`` for each row (doc_id, field_key, reason)."""
    payload = F.to_json(F.struct(F.col("field_key").alias("field"), "reason"))
    return escalations.select(F.lit(None).cast("double").alias("ts"), F.lit("escalate").alias("event"), F.lit(run_id).alias("run_id"), F.col("doc_id").cast("string").alias("doc_id"), payload.alias("payload"))


def drain(counted: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregate over what there is and return its complete result."""
    query = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counted.sparkSession.table(name)
