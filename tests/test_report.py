"""Gaps, reconciliation, escalations and argument errors on literal rows, nulls among them."""

import json

from plumbline.operators import report
from plumbline.operators import transcripts as T

ITEM, COUNT, AREA = "job long, schedule string, shape string, mark string", "job long, symbol_id string, sheet_page long, count long, verified boolean", "job long, room_number string"


def tables(spark):
    items = [(1, "window", "catalog", "W1"), (1, "window", "catalog", "W2"), (1, "window", "catalog", "W2"), (1, "finish", "instance", "N1"), (1, "finish", "instance", "N1"), (1, "finish", "instance", None), (2, "door", "instance", "D")]
    counts = [(1, "W1", 4, 2, True), (1, "W1", 5, 3, None), (2, "W2", 4, 1, False)]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(counts, COUNT), spark.createDataFrame([(2, "N1"), (1, "N9")], AREA)


def test_gaps(spark):
    items, counts, areas = tables(spark)
    assert sorted(map(tuple, report.gaps(items, counts, areas).collect()), key=repr) == [(1, "double_count", None, "W1", 5), (1, "without_area", "finish", "N1", None), (1, "without_counts", "window", "W2", None), (1, "without_counts", "window", "W2", None)]
    jobs = spark.createDataFrame([(1, None), (2, True), (3, False)], "job long, incomplete boolean")
    assert sorted(map(tuple, report.reconciled(jobs, items, counts, areas).collect())) == [(1, 3, 1, 1, 1, 1, 0, False, True), (2, 0, 0, 0, 1, 0, 0, True, False), (3, 0, 0, 0, 0, 0, 0, False, False)]


def test_artifact_leaves_out_wrong_escalations(spark):
    items, counts, areas = tables(spark)
    escalations = spark.createDataFrame([(1, 0, "window", "W1"), (1, 1, "windows", None), (1, 2, "", "N9"), (1, 3, None, "nothing"), (2, 0, "window", "D")], "job long, index long, schedule string, mark string")
    errors = report.escalation_errors(escalations, items, counts, areas)
    assert sorted(map(tuple, errors.collect())) == [(1, 1, "unknown schedule windows"), (1, 3, "unknown mark nothing"), (2, 0, "unknown schedule window")]
    jobs = spark.createDataFrame([(1, "succeeded", "abc", 7, "Prose")], "job long, status string, checksum string, page_count int, narrative string")
    summary = spark.createDataFrame([(1, "window", 3, 2.0)], "job long, schedule string, items long, quantity double")
    reconciliation = report.reconciled(spark.createDataFrame([(1, None)], "job long, incomplete boolean"), items, counts, areas)
    body = json.loads(report.artifact(jobs, summary, reconciliation, escalations, errors).first().body)
    assert [e["index"] for e in body["escalations"]] == [0, 2] and body["provenance"] == {"checksum": "abc", "page_count": 7}
    assert body["grounded_summary"] == [{"schedule": "window", "items": 3, "quantity": 2.0}] and body["reconciliation"]["has_gaps"] is True and body["incomplete"] is False


def test_argument_errors(spark):
    calls = spark.createDataFrame([("a", "f", '{"x": 1}'), ("b", "f", '{"x": 1}{"x": 2}'), ("c", "f", "[1]"), ("d", "f", "{"), ("e", "f", None), ("g", "h", "{}"), ("i", "f", "{}"), ("j", "f", "y" * 300)], "call_id string, name string, args string")
    got = {r.call_id: r.error for r in T.argument_errors(calls, spark.createDataFrame([("f", "x")], "name string, field string")).collect()}
    assert set(got) == {"b", "c", "d", "e", "i", "j"} and got["i"] == "f: invalid arguments, missing x" and got["j"].endswith("y…") and len(got["j"]) < 250


def test_assistant_blocks(spark):
    rows = [(1, 1, "hi", "why", 3, None), (1, 2, "no", None, None, [("c", "f", "{}"), ("d", "g", "{}")]), (1, 3, None, "", None, [])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, reasoning string, reasoning_tokens long, calls array<struct<id:string,name:string,args:string>>")
    got = sorted((r.turn, r.block_ord, r.kind, r.text, r.call_id) for r in T.assistant_blocks(df).collect())
    assert got == [(1, 0, "reasoning", "why", None), (1, 1, "text", "hi", None), (2, 0, "call", None, "c"), (2, 1, "call", None, "d"), (3, 0, "text", "", None)]
