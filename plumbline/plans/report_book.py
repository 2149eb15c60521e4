"""Deliverables on the driver's tables: orders are items of takeoffs, lines are counts on sheets, customers are areas.

A hundred-odd jobs share the rows by their numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import report
from plumbline.plans import knowledge
from plumbline.sources.tables import shared_folder

_ITEM = {
    "job": "o_custkey % 113", "schedule": "CASE o_orderkey % 5 WHEN 0 THEN 'finish' WHEN 1 THEN 'door' WHEN 2 THEN 'plumbing_fixture' WHEN 3 THEN 'lighting_fixture' ELSE 'window' END", "shape": "CASE WHEN o_orderkey % 5 < 2 THEN 'instance' ELSE 'catalog' END",
    "mark": "CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'N' || lpad(CAST(o_custkey % 500 AS STRING), 3, '0') ELSE 'P' || CAST(o_orderkey % 200 AS STRING) END", "quantity": "o_totalprice",
}
_COUNT = {"job": "l_suppkey % 120", "symbol_id": "'P' || CAST(l_partkey % 400 AS STRING)", "sheet_page": "CAST(l_linenumber AS BIGINT)", "count": "CAST(l_quantity AS BIGINT)", "verified": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag = 'A' END"}
_AREA = {"job": "c_custkey % 113", "room_number": "'N' || lpad(CAST(c_custkey * 7 % 500 AS STRING), 3, '0')"}
_JOB = {"job": "s_suppkey", "status": "CASE WHEN s_suppkey % 9 = 0 THEN 'failed' ELSE 'succeeded' END", "incomplete": "CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey % 4 = 0 END", "checksum": "s_name", "page_count": "s_nationkey", "narrative": "'Takeoff of ' || s_name"}
_ESCALATION = {"job": "c_custkey % 113", "index": "c_custkey", "schedule": "CASE c_custkey % 4 WHEN 0 THEN 'finish' WHEN 1 THEN 'doors' WHEN 2 THEN '' ELSE 'window' END", "mark": "CASE c_custkey % 3 WHEN 0 THEN 'P' || CAST(c_custkey % 450 AS STRING) WHEN 1 THEN 'N' || lpad(CAST(c_custkey * 7 % 600 AS STRING), 3, '0') END"}
_OF = {"items": ("orders", _ITEM), "counts": ("lineitem", _COUNT), "areas": ("customer", _AREA), "jobs": ("supplier", _JOB), "escalations": ("customer", _ESCALATION)}


def _made(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{_OF[n][0]}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in _OF[n][1].items())) for n in names]


_WITH = "WITH " + ", ".join(f"{n} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in of.items()) + f" FROM {t})" for n, (t, of) in _OF.items())
_GAPS = """, gap AS (
 SELECT job, 'without_counts' AS kind, schedule, mark AS key, NULL::BIGINT AS n FROM items i WHERE shape = 'catalog' AND mark <> '' AND NOT EXISTS (SELECT 1 FROM counts c WHERE c.job = i.job AND c.symbol_id = i.mark)
 UNION ALL SELECT job, 'double_count', NULL, symbol_id, CAST(sum(count) AS BIGINT) FROM counts GROUP BY job, symbol_id HAVING count(*) >= 2
 UNION ALL SELECT DISTINCT job, 'without_area', 'finish', mark, NULL FROM items i WHERE schedule = 'finish' AND mark <> '' AND NOT EXISTS (SELECT 1 FROM areas a WHERE a.job = i.job AND a.room_number = i.mark)),
rec AS (SELECT j.job, (SELECT count(*) FROM items i WHERE i.job = j.job AND shape = 'catalog' AND mark <> '') AS types, (SELECT count(*) FROM gap g WHERE g.job = j.job AND kind = 'without_counts') AS lost, (SELECT count(*) FROM gap g WHERE g.job = j.job AND kind = 'double_count') AS double_counts,
 (SELECT count(*) FROM counts c WHERE c.job = j.job AND NOT coalesce(verified, false)) AS unverified, (SELECT count(DISTINCT mark) FROM items i WHERE i.job = j.job AND schedule = 'finish' AND mark <> '') AS finish_rooms,
 (SELECT count(*) FROM gap g WHERE g.job = j.job AND kind = 'without_area') AS bare, coalesce(incomplete, false) AS incomplete FROM jobs j)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.gaps(*_made(spark, sf_dir, "items", "counts", "areas"))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's tiers against each other, in numbers that the tiers have."""
    return report.reconciled(*_made(spark, sf_dir, "jobs", "items", "counts", "areas"))


RECONCILED_SQL = f"{_WITH}{_GAPS} SELECT job, types, types - lost AS with_counts, double_counts, unverified, finish_rooms, finish_rooms - bare AS with_area, incomplete, lost + double_counts + bare > 0 AS has_gaps FROM rec"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations that name what their job does not have."""
    return report.escalation_errors(*_made(spark, sf_dir, "escalations", "items", "counts", "areas"))


_ERRORS = """, err AS (SELECT job, index, 'unknown schedule ' || schedule AS error FROM escalations e WHERE schedule <> '' AND NOT EXISTS (SELECT 1 FROM items i WHERE i.job = e.job AND i.schedule = e.schedule)
 UNION ALL SELECT job, index, 'unknown mark ' || mark FROM escalations e WHERE mark <> '' AND NOT EXISTS (SELECT 1 FROM items i WHERE i.job = e.job AND i.mark = e.mark)
 AND NOT EXISTS (SELECT 1 FROM counts c WHERE c.job = e.job AND c.symbol_id = e.mark) AND NOT EXISTS (SELECT 1 FROM areas a WHERE a.job = e.job AND a.room_number = e.mark))"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's artifact, written as JSON, read back and taken apart."""
    jobs, items, counts, areas, escalations = _made(spark, sf_dir, "jobs", "items", "counts", "areas", "escalations")
    summary = items.groupBy("job", "schedule").agg(F.count("*").alias("items"), F.round(F.sum(F.col("quantity").cast("decimal(20,2)")), 2).cast("double").alias("quantity"))
    made = report.artifact(jobs, summary, report.reconciled(jobs, items, counts, areas), escalations, report.escalation_errors(escalations, items, counts, areas))
    folder = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    report.write_json(made, folder)
    read = spark.read.schema(
        "job long, status string, incomplete boolean, grounded_summary array<struct<schedule:string,items:long,quantity:double>>, reconciliation struct<types:long,has_gaps:boolean>, provenance struct<checksum:string,page_count:int>, narrative string, escalations array<struct<index:long,schedule:string,mark:string>>"
    ).json(folder)
    shown = F.array_join(F.transform("grounded_summary", lambda s: F.concat_ws(":", s["schedule"], s["items"].cast("string"), F.format_number(s["quantity"], 2))), " ")
    listed = F.array_join(F.transform("escalations", lambda e: F.concat_ws(":", e["index"].cast("string"), e["schedule"], e["mark"])), " ")
    return read.select("job", "status", "incomplete", shown.alias("summary"), "reconciliation.types", "reconciliation.has_gaps", "provenance.checksum", "provenance.page_count", "narrative", listed.alias("escalations"))


ARTIFACTS_SQL = f"""{_WITH}{_GAPS}{_ERRORS}, s AS (SELECT job, string_agg(schedule || ':' || n || ':' || format('{{:,.2f}}', q), ' ' ORDER BY schedule) AS summary FROM (SELECT job, schedule, count(*) AS n, CAST(sum(CAST(quantity AS DECIMAL(20,2))) AS DOUBLE) AS q FROM items GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT job, string_agg(concat_ws(':', CAST(index AS VARCHAR), schedule, mark), ' ' ORDER BY index) AS escalations FROM escalations e WHERE NOT EXISTS (SELECT 1 FROM err WHERE err.job = e.job AND err.index = e.index) GROUP BY 1)
SELECT j.job, j.status, r.incomplete, coalesce(summary, '') AS summary, types, lost + double_counts + bare > 0 AS has_gaps, checksum, page_count, narrative, coalesce(escalations, '') AS escalations FROM jobs j JOIN rec r ON r.job = j.job LEFT JOIN s ON s.job = j.job LEFT JOIN x ON x.job = j.job"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of the assembled graph."""
    return report.graph_gates(*knowledge.graph(spark, sf_dir))


GATES_SQL = f"""{knowledge._GRAPH}, spec AS (SELECT DISTINCT source FROM edge WHERE relationship IN ('DOOR_SPECIFIED_IN', 'FRAME_SPECIFIED_IN', 'HARDWARE_SPECIFIED_IN', 'GLAZING_SPECIFIED_IN')), fin AS (SELECT DISTINCT source FROM edge WHERE relationship = 'FINISH_SPECIFIED_IN'),
n AS (SELECT count(*) FILTER (node_type = 'section') AS section, count(*) FILTER (node_type = 'sheet') AS sheet, count(*) FILTER (node_type = 'abbreviation') AS abbreviation, count(*) FILTER (node_type = 'room') AS room, count(*) FILTER (node_type = 'door') AS door,
 count(*) FILTER (node_type IN ('door', 'room') AND key NOT IN (SELECT source FROM edge UNION ALL SELECT target FROM edge)) AS alone, count(*) FILTER (node_type = 'door' AND key IN (SELECT source FROM spec)) AS doors, count(*) FILTER (node_type = 'room' AND key IN (SELECT source FROM fin)) AS rooms FROM node)
SELECT 'phase2' AS phase, k || 's_parsed' AS name, v > 0 AS passed, CAST(v AS DOUBLE) AS metric FROM (SELECT unnest(['section', 'door', 'room', 'abbreviation']) AS k, unnest([section, door, room, abbreviation]) AS v FROM n)
UNION ALL SELECT 'phase3', 'sheets_registered', sheet > 0, sheet FROM n UNION ALL SELECT 'phase5', 'element_connectivity', alone = 0, alone FROM n
UNION ALL SELECT 'phase5', 'door_to_spec_rate', doors / door >= 0.9, round(doors / door, 3) FROM n UNION ALL SELECT 'phase5', 'room_to_finish_rate', rooms / room >= 0.9, round(rooms / room, 3) FROM n"""


def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text has all words of any schedule's signature, by source: their list in order, and how many pages there are."""
    from plumbline.operators.schema_resolver import SCHEMAS

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.concat_ws(" ", "text", F.expr(_SIGNED)).alias("text"))
    any_ = F.lit(False)
    for s in SCHEMAS:
        any_ = any_ | X.has_all(F.col("text"), F.array(*map(F.lit, s.signature)))
    return d.withColumn("_c", F.coalesce(any_, F.lit(False))).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_c"), F.col("doc_id")))), lambda x: x.cast("string")), " ").alias("candidates"), F.count("*").alias("pages"))


_SIGNED = "CASE n_chars % 23 WHEN 0 THEN 'Door Schedule' WHEN 1 THEN 'PLUMBING list' WHEN 2 THEN 'Lighting FIXTURES' WHEN 3 THEN 'camera schedule' WHEN 4 THEN 'Security devices' ELSE '' END"
CANDIDATES_SQL = f"""WITH d AS (SELECT doc_id, source, lower(text || ' ' || {_SIGNED}) AS t FROM documents), k AS (SELECT *, (contains(t, 'door') AND contains(t, 'schedule')) OR (contains(t, 'finish') AND contains(t, 'schedule')) OR (contains(t, 'plumbing') AND contains(t, 'fixture'))
 OR (contains(t, 'window') AND contains(t, 'schedule')) OR (contains(t, 'lighting') AND contains(t, 'fixture')) OR (contains(t, 'camera') AND contains(t, 'schedule')) OR (contains(t, 'security') AND contains(t, 'device')) AS c FROM d)
SELECT source, coalesce(string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) FILTER (c), '') AS candidates, count(*) AS pages FROM k GROUP BY source"""

QUERIES = {"a19_gaps": gaps, "a19_tiers": reconciled, "j19_errors": errors, "a27_artifacts": artifacts, "a14_gates": gates, "s17_candidates": candidate_pages}
ORACLE_SQL = {
    "a19_gaps": f"{_WITH}{_GAPS} SELECT * FROM gap", "a19_tiers": RECONCILED_SQL, "j19_errors": f"{_WITH}{_ERRORS} SELECT * FROM err", "a27_artifacts": ARTIFACTS_SQL, "a14_gates": GATES_SQL, "s17_candidates": CANDIDATES_SQL,
}
