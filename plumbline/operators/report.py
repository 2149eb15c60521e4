"""What a takeoff delivers: gaps between its tiers, checked escalations, gates, and one artifact for each job.

Gaps are rows, so a job of any size has any number of them; an artifact holds the job's roll-ups and the counts of its
gaps, and lists only what is bounded by the number of schedules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaps(items: DataFrame, counts: DataFrame, areas: DataFrame) -> DataFrame:
    """job, kind, schedule, key, n: no number is made here that the tiers do not have.

    items (job, schedule, shape, mark), counts (job, symbol_id, sheet_page, count, verified), areas (job, room_number).
    without_counts: marks of catalogues that no sheet counts (n null), once for each item; double_count: symbols on two
    sheets or more, with the total of all; without_area: rooms of finish schedules with no area.
    """
    named = items.filter(F.coalesce("mark", F.lit("")) != "")
    catalog = named.filter("shape = 'catalog'").select("job", "schedule", F.col("mark").alias("key"))
    seen = counts.select("job", F.col("symbol_id").alias("key")).distinct()
    none = F.lit(None)
    missing = catalog.join(seen, ["job", "key"], "left_anti").select("job", F.lit("without_counts").alias("kind"), "schedule", "key", none.cast("long").alias("n"))
    per = counts.groupBy("job", F.col("symbol_id").alias("key")).agg(F.count("*").alias("sheets"), F.sum("count").cast("long").alias("n"))
    double = per.filter("sheets >= 2").select("job", F.lit("double_count").alias("kind"), none.cast("string").alias("schedule"), "key", "n")
    rooms = named.filter("schedule = 'finish'").select("job", F.col("mark").alias("key")).distinct()
    bare = rooms.join(areas.select("job", F.col("room_number").alias("key")).distinct(), ["job", "key"], "left_anti").select("job", F.lit("without_area").alias("kind"), F.lit("finish").alias("schedule"), "key", none.cast("long").alias("n"))
    return missing.unionByName(double).unionByName(bare)


def reconciled(jobs: DataFrame, items: DataFrame, counts: DataFrame, areas: DataFrame) -> DataFrame:
    """job, types, with_counts, double_counts, unverified, finish_rooms, with_area, incomplete, has_gaps of ``jobs`` (job, incomplete)."""
    g = gaps(items, counts, areas).groupBy("job").agg(*(F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("without_counts", "double_count", "without_area")))
    named = F.coalesce("mark", F.lit("")) != ""
    i = items.groupBy("job").agg(F.count_if(named & (F.col("shape") == "catalog")).alias("_types"), F.countDistinct(F.when(named & (F.col("schedule") == "finish"), F.col("mark"))).alias("_rooms"))
    c = counts.groupBy("job").agg(F.count_if(~F.coalesce("verified", F.lit(False))).alias("_open"))
    j = jobs.join(g, "job", "left").join(i, "job", "left").join(c, "job", "left")
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    lost, double, bare, types, rooms = (n(x) for x in ("_without_counts", "_double_count", "_without_area", "_types", "_rooms"))
    return j.select(
        "job", types.alias("types"), (types - lost).alias("with_counts"), double.alias("double_counts"), n("_open").alias("unverified"), rooms.alias("finish_rooms"), (rooms - bare).alias("with_area"),
        F.coalesce("incomplete", F.lit(False)).alias("incomplete"), (lost + double + bare > 0).alias("has_gaps"),
    )


def escalation_errors(escalations: DataFrame, items: DataFrame, counts: DataFrame, areas: DataFrame) -> DataFrame:
    """job, index, error of ``escalations`` (job, index, schedule, mark) that name a schedule or a mark their job does not have.

    A mark may be an item's, a counted symbol's or a room's; empty ones are not checked.
    """
    asked = lambda c: escalations.filter(F.coalesce(c, F.lit("")) != "").select("job", "index", F.col(c).alias("_x"))
    schedules = items.select("job", F.col("schedule").alias("_x")).distinct()
    marks = items.select("job", F.col("mark").alias("_x")).unionByName(counts.select("job", F.col("symbol_id").alias("_x"))).unionByName(areas.select("job", F.col("room_number").alias("_x"))).distinct()
    said = lambda df, what: df.select("job", "index", F.concat(F.lit(f"unknown {what} "), "_x").alias("error"))
    return said(asked("schedule").join(schedules, ["job", "_x"], "left_anti"), "schedule").unionByName(said(asked("mark").join(marks, ["job", "_x"], "left_anti"), "mark"))


def artifact(jobs: DataFrame, summary: DataFrame, reconciliation: DataFrame, escalations: DataFrame, errors: DataFrame) -> DataFrame:
    """job, body: the deliverable of every job as JSON, its numbers copied from what was computed.

    jobs (job, status, checksum, page_count, narrative), summary (job, schedule, items, quantity); an escalation with an
    error is left out.
    """
    rollup = summary.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("schedule", "items", "quantity"))).alias("_summary"))
    good = escalations.join(errors.select("job", "index").distinct(), ["job", "index"], "left_anti")
    listed = good.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("index", "schedule", "mark"))).alias("_escalations"))
    r = reconciliation.select("job", F.struct(*(c for c in reconciliation.columns if c != "job")).alias("_r"))
    j = jobs.join(rollup, "job", "left").join(r, "job", "left").join(listed, "job", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    body = F.struct(
        "job", "status", F.col("_r.incomplete").alias("incomplete"), empty("_summary", "array<struct<schedule:string,items:bigint,quantity:double>>").alias("grounded_summary"), F.col("_r").alias("reconciliation"),
        F.struct("checksum", "page_count").alias("provenance"), "narrative", empty("_escalations", "array<struct<index:bigint,schedule:string,mark:string>>").alias("escalations"),
    )
    return j.select("job", F.to_json(body).alias("body"))


def write_json(artifacts: DataFrame, folder: str) -> None:
    """One line of JSON for each artifact."""
    artifacts.select(F.col("body").alias("value")).write.mode("overwrite").text(folder)


def _gate(phase: str, name: str, passed: Column, metric: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("name"), passed.alias("passed"), metric.cast("double").alias("metric"))


def graph_gates(nodes: DataFrame, edges: DataFrame, least: float = 0.9) -> DataFrame:
    """phase, name, passed, metric of an assembled graph: what was parsed, whether elements are connected, and how many find their sections."""
    specified = ["DOOR_SPECIFIED_IN", "FRAME_SPECIFIED_IN", "HARDWARE_SPECIFIED_IN", "GLAZING_SPECIFIED_IN"]
    out = edges.groupBy(F.col("source_type").alias("node_type"), F.col("source").alias("key")).agg(F.max(F.col("relationship").isin(specified)).alias("_spec"), F.max(F.col("relationship") == "FINISH_SPECIFIED_IN").alias("_finish"))
    into = edges.select(F.col("target_type").alias("node_type"), F.col("target").alias("key")).distinct().withColumn("_in", F.lit(True))
    j = nodes.join(out, ["node_type", "key"], "left").join(into, ["node_type", "key"], "left")
    kind = lambda k: F.col("node_type") == k
    alone = F.col("_spec").isNull() & F.col("_in").isNull()
    counts = {k: F.count_if(kind(k)) for k in ("section", "sheet", "abbreviation", "room", "door")}
    one = j.agg(
        *(c.alias(k) for k, c in counts.items()), F.count_if(alone & F.col("node_type").isin("door", "room")).alias("alone"), F.count_if(kind("door") & F.coalesce("_spec", F.lit(False))).alias("doors"),
        F.count_if(kind("room") & F.coalesce("_finish", F.lit(False))).alias("rooms"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    parsed = [_gate("phase2", f"{k}s_parsed", F.col(k) > 0, F.col(k)) for k in ("section", "door", "room", "abbreviation")] + [_gate("phase3", "sheets_registered", F.col("sheet") > 0, F.col("sheet"))]
    graph = [
        _gate("phase5", "element_connectivity", F.col("alone") == 0, F.col("alone")), _gate("phase5", "door_to_spec_rate", rate("doors", "door") >= least, F.round(rate("doors", "door"), 3)),
        _gate("phase5", "room_to_finish_rate", rate("rooms", "room") >= least, F.round(rate("rooms", "room"), 3)),
    ]
    return one.select(F.inline(F.array(*parsed, *graph)))
