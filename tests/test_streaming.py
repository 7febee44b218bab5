import json
import os
import random
from pathlib import Path

import pytest

from docsift.operators import gold, lookup
from docsift.plans import reviews
from docsift.rules import RuleSet
from docsift.sources import files, runlog
from docsift.streaming import events


def log(tmp_path):
    rows = [
        {"ts": 0.1, "event": "state_resolved", "run_id": "r", "doc_id": "a", "payload": json.dumps({"state": "auto"})},
        {"ts": 0.2, "event": "retry", "run_id": "r", "doc_id": "a", "payload": json.dumps({"changed": True})},
        {"ts": 0.3, "event": "retry", "run_id": "r", "doc_id": "b", "payload": json.dumps({"changed": False})},
        {"ts": 400.0, "event": "human_action", "run_id": "r", "doc_id": "b", "payload": json.dumps({"field": "tag", "action": "approve"})},
        {"ts": 500.0, "event": "human_action", "run_id": "r", "doc_id": "b", "payload": json.dumps({"field": "tag", "action": "override"})},
    ]
    folder = tmp_path / "log"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[k::2]))
    return str(folder)


def test_stream_equals_batch(spark, tmp_path):
    folder = log(tmp_path)
    batch = events.counters(events.read_events(spark, folder, stream=False))
    streamed = events.drain(events.counters(events.read_events(spark, folder, per_trigger=1)), "stream_counters", str(tmp_path / "checkpoint"))
    want = {("retry", 2), ("retry_value_changed", 1), ("state_resolved", 1), ("state:auto", 1), ("human_action", 2)}
    assert {(r.counter, r.n) for r in batch.collect()} == {(r.counter, r.n) for r in streamed.collect()} == want


def test_windows_and_last_actions(spark, tmp_path):
    batch = events.read_events(spark, log(tmp_path), stream=False)
    assert [(r.doc_id, r.field_key, r.action) for r in events.last_actions(batch).collect()] == [("b", "tag", "override")]
    timed = events.windowed(events.with_time(batch, "2024-01-01 00:00:00"))
    assert sorted((r.event, r.n) for r in timed.collect()) == [("human_action", 2), ("retry", 2), ("state_resolved", 1)]


def test_gold_sheet_to_long_rows(spark):
    cells = [("k", 1, 1, "General"), ("k", 1, 3, "Body"), ("k", 2, 1, "File"), ("k", 2, 2, "Tag"), ("k", 2, 3, "Size"), ("k", 2, 4, "Rating"), ("k", 3, 1, "a.pdf"), ("k", 3, 2, "T1"), ("k", 3, 3, "4"), ("k", 4, 1, "note")]
    got = files.gold_from_cells(spark.createDataFrame(cells, "doc_id string, row int, col int, value string"), {1: "file"})
    assert sorted((r.file, r.group, r.head, r.value) for r in got.collect()) == [("a.pdf", "Body", "Size", "4"), ("a.pdf", "General", "Tag", "T1")]


def test_revised_actions_whatever_the_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"ts": float(t), "event": "human_action", "run_id": "r", "doc_id": f"d{rng.randrange(4)}", "payload": json.dumps({"field": rng.choice("ab"), "action": rng.choice(["approve", "override", "undo"]), "human_value": str(t)})} for t in range(200)]
    rows += [{"ts": 1.0, "event": "retry", "run_id": "r", "doc_id": "d0", "payload": "{}"}]
    want = {}
    for r in sorted(rows[:200], key=lambda r: r["ts"]):
        p = json.loads(r["payload"])
        want[r["doc_id"], p["field"]] = (None if p["action"] == "undo" else p["action"], p["human_value"] if p["action"] == "override" else None)
    rng.shuffle(rows)
    folder = tmp_path / "log"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[k::4]))
    out = str(tmp_path / "changes")
    log = events.read_events(spark, str(folder), per_trigger=1)
    events.write_stream(events.revised_actions(log, "2024-01-01 00:00:00"), out, str(tmp_path / "checkpoint"), "parquet", "update")
    changes = spark.read.schema(events.ACTION).option("recursiveFileLookup", "true").parquet(out)
    assert {(r.doc_id, r.field_key): (r.action, r.human_value) for r in events.current(changes).collect()} == want
    assert changes.count() > len(want)  # what was sent early has been revised


def test_revised_actions_keep_state_without_python(spark, tmp_path):
    """State is Spark's own, a row for each document, field and day, and goes with the watermark; what isn't the last says nothing."""
    day = 86_400.0
    told = [[("a", day + 10, "override", "5")], [("a", day - 10, "approve", None), ("c", day, "approve", None)], [("a", day + 5, "undo", None)], [("c", day, "undo", None)], [("b", 5 * day, "approve", None)]]
    folder = tmp_path / "log"
    folder.mkdir()
    for k, rows in enumerate(told):
        path = folder / f"{k}.jsonl"
        path.write_text("\n".join(json.dumps({"ts": t, "event": "human_action", "run_id": "r", "doc_id": d, "payload": json.dumps({"field": "tag", "action": a, "human_value": v})}) for d, t, a, v in rows))
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    changes = events.revised_actions(events.read_events(spark, str(folder), per_trigger=1), "2024-01-01 00:00:00")
    query = changes.writeStream.outputMode("update").format("memory").queryName("revised").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = query.lastProgress["stateOperators"]
    assert [s["operatorName"] for s in state] == ["stateStoreSave"] and [s["numRowsTotal"] for s in state] == [1]
    sent = spark.table("revised")
    assert sorted((r.doc_id, r.ts, r.action or "", r.human_value or "") for r in sent.collect()) == [("a", day - 10, "approve", ""), ("a", day + 10, "override", "5"), ("b", 5 * day, "approve", ""), ("c", day, "", ""), ("c", day, "approve", "")]
    assert {(r.doc_id, r.action, r.human_value) for r in events.current(sent).collect()} == {("a", "override", "5"), ("b", "approve", None), ("c", None, None)}


def test_events_of_a_folder_are_read_whole(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test data")
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(map(str, reviews.q74b_revised_actions(spark, d).collect())) for d in (str(tmp_path), data))
    assert got == want and got


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(t, "retry", "r", "d", None) for t in ts], events.EVENT)
    path = str(tmp_path / "log")
    runlog.append_events(rows(1.0, 2.0), path, "one")
    runlog.append_events(rows(1.0, 2.0), path, "one")
    runlog.append_events(rows(3.0), path)
    runlog.append_events(rows(4.0), path)
    assert sorted(r.ts for r in events.read_events(spark, path, stream=False).collect()) == [1.0, 2.0, 3.0, 4.0]
    copy = str(tmp_path / "copy")
    for checkpoint in ("a", "b"):  # a second query without the first one's progress repeats its batches
        events.write_stream(events.read_events(spark, path), copy, str(tmp_path / checkpoint))
    assert sorted(r.ts for r in events.read_events(spark, copy, stream=False).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_cache_makes_its_folder(spark, tmp_path):
    path = str(tmp_path / "none" / "cache")
    runlog.put_answers(spark, path, spark.createDataFrame([("a", "1")], "key string, payload string"))
    assert [tuple(r) for r in spark.read.schema("key string, payload string").json(path).collect()] == [("a", "1")]


def test_sections_of_bands(spark):
    marks = spark.createDataFrame([("d", "body", 10.0, 4.0), ("d", "trim", 30.0, 4.0)], "doc_id string, section string, centre double, height double")
    got = {r.section: (r.lo, r.hi) for r in lookup.section_bands(marks, ["doc_id"]).collect()}
    assert got == {"body": (0.0, 20.0), "trim": (20.0, 40.0)}


def test_labels_in_sections(spark):
    rules = RuleSet()
    rows = [(1, "Tag No", None, None), (2, "Model No.", None, None), (3, "Model No.", "body", ["model"]), (4, "Tag No", "none", []), (5, "Size (inch)", None, None), (6, None, None, None)]
    labels = spark.createDataFrame(rows, "label_id int, label string, section string, allowed array<string>")
    got = {r.label_id: r.field_key for r in lookup.lookup_labels(labels, rules.labels(spark)).collect()}
    assert got == {1: "tag", 3: "model", 5: "body_size"}


def test_gold_history(spark, tmp_path):
    row = spark.createDataFrame([(91.0,)], "lenient double")
    for run in ("one", "two"):
        gold.append_history(row, run, str(tmp_path / "history"))
    assert {r.run_id for r in spark.read.parquet(str(tmp_path / "history")).collect()} == {"one", "two"}
    decided = spark.createDataFrame([("maker", "NORTHGT", "NORTHGATE", True), ("maker", "NEW", None, False)], "field_key string, value string, to string, correctable boolean")
    assert {r.block for r in gold.approved_rules(decided).collect()} == {"value_aliases", "flag_only"}
