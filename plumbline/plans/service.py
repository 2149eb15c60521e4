"""Service semantics on tables: jobs and shards, replace by key, filtered queries, streams and transcripts of calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ordered import first_wins
from plumbline.streaming import ingest


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Rows of each key in ``df`` replace that key's rows at ``path``; other keys stay (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def filtered(df: DataFrame, equal: dict | None = None, least: dict | None = None) -> DataFrame:
    """Equality and lower bounds; arguments that are None do not filter."""
    for k, v in (equal or {}).items():
        df = df if v is None else df.filter(F.col(k) == F.lit(v))
    for k, v in (least or {}).items():
        df = df if v is None else df.filter(F.col(k) >= F.lit(v))
    return df


def job_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: the newest active job of each content (customer and priority); failed ones do not count."""
    jobs = _t(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return first_wins(jobs, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


JOBS_SQL = "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r = 1"


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their shards: done, failed and whether the result is incomplete."""
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("shards"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = o.join(line, o["o_orderkey"] == line["l_orderkey"], "left")
    return j.select("o_orderkey", "o_orderstatus", F.coalesce("shards", F.lit(0)).alias("shards"), F.coalesce("failed", F.lit(0)).alias("failed"), (F.coalesce("failed", F.lit(0)) > 0).alias("incomplete"))


STATUS_SQL = "SELECT o_orderkey, o_orderstatus, coalesce(shards, 0) AS shards, coalesce(failed, 0) AS failed, coalesce(failed, 0) > 0 AS incomplete FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS shards, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filtered(_t(spark, sf_dir, "lineitem"), {"l_returnflag": "A", "l_linestatus": None}, {"l_quantity": 30.0, "l_tax": None})
    return got.agg(F.count("*").alias("total"), F.sum("l_quantity").alias("quantity"))


FILTERS_SQL = "SELECT count(*) AS total, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 30"


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shred: each order's lines as rows with their place in it and defaults filled in."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    rows = _t(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(at) - 1)
    return rows.select("l_orderkey", "ordinal", F.col("l_partkey").alias("mark"), F.coalesce("l_quantity", F.lit(0.0)).alias("quantity"))


PROJECTED_SQL = "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS INTEGER) AS ordinal, l_partkey AS mark, l_quantity AS quantity FROM lineitem"


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writing a key's rows twice leaves them once."""
    from plumbline.sources.tables import shared_folder

    path = f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}"
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    replace_by_key(o, path, "o_orderstatus")
    replace_by_key(o.filter("o_orderstatus = 'O'"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


REPLACED_SQL = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as streamed call fragments, accumulated for each user and day of a month."""
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "tool_start").when(F.col("event_type") == "view", "text").otherwise("tool_delta")
    rows = e.select(F.col("user_id").cast("string").alias("response_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).alias("id"), "event_type", F.lit("t").alias("text"), F.lit("1").alias("args_fragment")).withColumnRenamed("event_type", "name")
    got = ingest.accumulate(rows)
    return got.select("response_id", F.length("text").alias("texts"), F.coalesce(F.size("calls"), F.lit(0)).alias("calls"), F.aggregate(F.coalesce("calls", F.array().cast("array<struct<first:bigint,id:string,name:string,args:string>>")), F.lit(0), lambda s, c: s + F.length(F.coalesce(c["args"], F.lit("")))).alias("fragments"))


CALLS_SQL = """WITH e AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events)
SELECT CAST(user_id AS VARCHAR) AS response_id, CAST(count(*) FILTER (event_type = 'view') AS INTEGER) AS texts, CAST(count(DISTINCT coalesce(owner, -1)) FILTER (event_type <> 'view') AS INTEGER) AS calls, CAST(count(*) FILTER (event_type <> 'view') AS INTEGER) AS fragments FROM e GROUP BY user_id"""


def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a stream over ``events``, unique by id, counted by day and type; each batch writes its whole result."""
    from plumbline.sources.tables import shared_folder

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _t(spark, sf_dir, "events").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    counts = ingest.tumbling(ingest.events_stream(spark, f"{base}/in", schema).dropDuplicates(["event_id"]), "1 day")
    return ingest.run_complete(counts, f"{base}/out", f"{base}/state").select(F.to_date("start").alias("day"), "event_type", "n")


STREAM_SQL = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as spans between full stops: how many each document has, and the longest."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("spans"), F.max(F.length("s")).alias("longest"))


SPANS_SQL = "SELECT doc_id, count(*) AS spans, max(length(s)) AS longest FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents) GROUP BY doc_id"


def sequence_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional numbers in reading order: parts of each brand by name."""
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("number"))


MARKS_SQL = "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS INTEGER) AS number FROM part"

QUERIES = {"j22_job_dedupe": job_dedupe, "m1_job_status": job_status, "f33_filters": filters, "k2_project": projected, "k3_replace": replaced, "t2_calls": calls, "t5_daily_stream": daily_stream, "w8_spans": spans, "w24_numbers": sequence_marks}
ORACLE_SQL = {"j22_job_dedupe": JOBS_SQL, "m1_job_status": STATUS_SQL, "f33_filters": FILTERS_SQL, "k2_project": PROJECTED_SQL, "k3_replace": REPLACED_SQL, "t2_calls": CALLS_SQL, "t5_daily_stream": STREAM_SQL, "w8_spans": SPANS_SQL, "w24_numbers": MARKS_SQL}
