"""Streams over the driver's tables, written to files that a stream takes some at a time.

Eight events in a row are the fragments of a response; an order is a job, its lines are shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import shared_folder, stored
from plumbline.streaming import fan_in
from plumbline.streaming import responses as R

BATCHES = 3


def _streamed(df: DataFrame, by: str, last: DataFrame | None = None) -> tuple[DataFrame, str]:
    """A stream of ``df`` in some BATCHES batches dealt by a hash of ``by``, then ``last``; and the folder of its run."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    made = stored(df.repartition(spark.sparkContext.defaultParallelism), "fragments")
    for i in range(BATCHES):
        made.filter(F.pmod(F.xxhash64(by), F.lit(BATCHES)) == i).write.mode("append").parquet(f"{base}/in")
    # A batch takes as many files as each of the writes has made.
    files = len(spark.read.schema(df.schema).parquet(f"{base}/in").inputFiles())
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(f"{base}/in"), base


_KIND = """CASE WHEN event_id % 8 = 7 AND CAST(floor(event_id / 8) AS BIGINT) % 5 <> 0 THEN 'completed' WHEN event_type = 'click' THEN 'tool_call_start' WHEN event_type = 'view' THEN 'text_delta'
 WHEN event_type = 'signup' THEN 'reasoning_delta' ELSE 'tool_call_delta' END"""
_PART = "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '!' ELSE props END"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that a stream of fragments makes; every fifth one has no end and is closed as abandoned."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.floor(F.col("event_id") / 8).cast("string").alias("response_id"), (F.col("event_id") % 8).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_KIND).alias("kind"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("id"), F.when(F.col("event_type") == "click", F.lit("tool")).alias("name"), F.expr(_PART).alias("text"),
        F.col("user_id").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"),
    )
    ends = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    tick = ends.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    stream, base = _streamed(events, "seq", tick)
    found = R.responses(stream, "1 DAYS", "365 days")
    found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    shown = F.array_join(F.transform("calls", lambda c: F.concat(c["id"], F.lit(":"), c["name"], F.lit(":"), F.coalesce(c["args"], F.lit("-")))), " ")
    return spark.read.schema(found.schema).parquet(f"{base}/out").select("response_id", "status", "text", "reasoning", shown.alias("calls"), "input_tokens", "output_tokens")


RESPONSES_SQL = f"""WITH e AS (SELECT CAST(event_id // 8 AS VARCHAR) AS response_id, event_id AS n, {_KIND} AS kind, {_PART} AS part, event_type, user_id FROM events),
o AS (SELECT *, coalesce('c' || last_value(CASE WHEN kind = 'tool_call_start' THEN n END IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'orphan') AS owner FROM e),
c AS (SELECT response_id, owner, min(n) AS first, bool_or(kind = 'tool_call_start') AS named, coalesce(string_agg(part, '' ORDER BY n) FILTER (kind = 'tool_call_delta'), '') AS raw FROM o WHERE kind LIKE 'tool_call%' GROUP BY 1, 2),
k AS (SELECT response_id, string_agg(owner || ':' || CASE WHEN named THEN 'tool' ELSE '' END || ':' || CASE WHEN raw = '' THEN '{{}}' WHEN json_valid(raw) THEN raw ELSE '-' END, ' ' ORDER BY first) AS calls FROM c GROUP BY 1)
SELECT e.response_id, CASE WHEN bool_or(kind = 'completed') THEN 'completed' ELSE 'abandoned' END AS status, coalesce(string_agg(part, '' ORDER BY n) FILTER (kind = 'text_delta'), '') AS text,
 coalesce(string_agg(part, '' ORDER BY n) FILTER (kind = 'reasoning_delta'), '') AS reasoning, coalesce(any_value(k.calls), '') AS calls, max(user_id) FILTER (kind = 'completed') AS input_tokens, max(n % 100) FILTER (kind = 'completed') AS output_tokens
FROM e LEFT JOIN k ON k.response_id = e.response_id GROUP BY e.response_id"""


def fanned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose shards have all finished, each with what its reduce merges; jobs with a failed shard wait."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shards = stored(line.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("shard_index")).agg(F.max("l_returnflag").alias("flag"), F.sum("l_quantity").alias("quantity")), "shards")
    counts = shards.groupBy("job").agg(F.count("*").alias("shard_count"))
    status = F.when(F.col("flag") == "R", "dead").when((F.col("job") % 9 == 0) & (F.col("shard_index") == 1), "failed").otherwise("succeeded")
    reports = shards.join(counts, "job").select("job", "shard_index", "shard_count", status.alias("status"))
    stream, base = _streamed(reports, "shard_index")
    alive = stored(shards.filter("flag <> 'R'").groupBy("job").agg(F.sum("quantity").alias("quantity")), "alive")

    def reduce(jobs: DataFrame) -> DataFrame:
        return jobs.join(alive, "job", "left")

    sink = fan_in.into_batches(reduce, f"{base}/out")
    fan_in.released(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{fan_in.RELEASED}, quantity double").parquet(f"{base}/out/batch=*").select("job", "shard_count", "dead", (F.col("dead") > 0).alias("incomplete"), "quantity")


FAN_IN_SQL = """WITH s AS (SELECT l_orderkey AS job, l_linenumber AS i, max(l_returnflag) AS flag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT job, count(*) AS shard_count, count(*) FILTER (flag = 'R') AS dead, count(*) FILTER (flag = 'R') > 0 AS incomplete, sum(quantity) FILTER (flag <> 'R') AS quantity
FROM s GROUP BY job HAVING NOT bool_or(flag <> 'R' AND job % 9 = 0 AND i = 1)"""

QUERIES = {"t1_responses": responses, "t7_fan_in": fanned_in}
ORACLE_SQL = {"t1_responses": RESPONSES_SQL, "t7_fan_in": FAN_IN_SQL}
