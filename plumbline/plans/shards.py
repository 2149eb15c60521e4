"""Shards, ledgers and requests on the driver's tables.

Customers are rows of schedules on pages, the words of sheets are those of the drawings; web pages are pages that may
fail; events are requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import ledger, ordered, requests, sheets, waves
from plumbline.plans import drawings

_ITEM = {
    "page": "c_custkey % 300", "row_ord": "c_custkey", "schedule": "CASE c_custkey % 3 WHEN 0 THEN 'finish' WHEN 1 THEN 'door' ELSE 'window' END",
    "mark": "CASE WHEN c_custkey % 2 = 0 THEN 'N' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') ELSE 'S' || lpad(CAST(c_custkey % 500 AS STRING), 3, '0') || 'A' END", "name": "c_name",
}
#: Candidates for a window; the answers have to be the same.
CAPS = (7, 1000)


def _waves(spark: SparkSession, sf_dir: str, cap: int) -> tuple[DataFrame, DataFrame]:
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*(f"{e} AS {n}" for n, e in _ITEM.items()))
    windows = ordered.windows(items, "page", 0, 300, cap)
    return waves.two_waves(items, sheets.positioned(drawings.words(spark, sf_dir)), windows, 2)


def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged items of all shards, for two caps."""
    return reduce(DataFrame.unionByName, [_waves(spark, sf_dir, c)[0].select(F.lit(c).alias("cap"), "schedule", "mark", "page", "row_ord", "name") for c in CAPS])


def two_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the rooms that finish schedules name, for two caps of the first wave's shards."""
    return reduce(DataFrame.unionByName, [_waves(spark, sf_dir, c)[1].select(F.lit(c).alias("cap"), "*") for c in CAPS])


_CAPS = f"(SELECT unnest({list(CAPS)}) AS cap)"
_MERGED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schedule, mark ORDER BY page, row_ord) AS n FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _ITEM.items())} FROM customer)) WHERE n = 1)"
MERGED_SQL = f"SELECT cap, schedule, mark, page, row_ord, name FROM {_MERGED}, {_CAPS}"
WAVES_SQL = f"""WITH room AS (SELECT DISTINCT mark FROM {_MERGED} WHERE schedule = 'finish'), label AS (SELECT * FROM {drawings._LABELS}), spot AS (SELECT p.* FROM {drawings._POSITIONED} p WHERE text IN (SELECT mark FROM room)),
plan AS (SELECT page FROM (SELECT page, count(*) AS n FROM label GROUP BY 1) WHERE n >= 2 INTERSECT SELECT page FROM (SELECT page, count(*) AS n FROM spot GROUP BY 1) WHERE n >= 2),
pair AS (SELECT l.page, l.pos AS label, l.area, a.pos AS place, a.text AS room, sqrt((l.x - a.x) * (l.x - a.x) + (l.y - a.y) * (l.y - a.y)) AS d FROM label l JOIN spot a ON a.page = l.page WHERE l.page IN (SELECT page FROM plan) AND area <= 20000),
bound AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY d, place) AS n FROM pair WHERE d <= 100) WHERE n = 1),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY page, d, label) AS k FROM bound) WHERE k = 1)
SELECT cap, room AS room_number, area, greatest(round(1 - d / 100, 3), 0) AS confidence, page FROM first, {_CAPS}"""


def _between(text: str, begin: str, end: str):
    return F.nullif(F.regexp_extract(text, f"(?s){begin}(.*?){end}", 1), F.lit(""))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt on every web page: a value, or why there is none; pages that do not load are skipped."""
    pages = ledger.window(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", 0)
    load = F.when(F.coalesce(F.length("html"), F.lit(0)) == 0, "empty page").when(F.length("html") % 13 == 0, F.concat(F.lit("bad length "), F.length("html").cast("string")))
    host = F.nullif(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit(""))
    operations = [
        ledger.Operation("title", _between("html", "<title>", "</title>"), F.lit("no title")), ledger.Operation("heading", F.length(_between("html", "<h1[^>]*>", "</h1>")), F.lit("no heading")),
        ledger.Operation("host", host, F.concat(F.lit("no host in "), F.coalesce("url", F.lit("null")))), ledger.Operation("number", F.nullif(F.regexp_extract("url", r"(\d+)\D*$", 1), F.lit("")).try_cast("bigint"), F.lit("no number")),
    ]
    values, lost = ledger.attempted(pages, ["page_id"], load, operations)
    return values.withColumn("error", F.lit(None).cast("string")).unionByName(lost.withColumn("value", F.lit(None).cast("string")))


FAILURES_SQL = """WITH p AS (SELECT *, CASE WHEN length(html) = 0 THEN 'empty page' WHEN length(html) % 13 = 0 THEN 'bad length ' || length(html) END AS lost FROM pages), ok AS (SELECT * FROM p WHERE lost IS NULL)
SELECT page_id, op, value, CASE WHEN value IS NULL THEN problem END AS error FROM (
 SELECT page_id, 'title' AS op, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS value, 'no title' AS problem FROM ok
 UNION ALL SELECT page_id, 'heading', CAST(length(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '')) AS VARCHAR), 'no heading' FROM ok
 UNION ALL SELECT page_id, 'host', nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), ''), 'no host in ' || url FROM ok
 UNION ALL SELECT page_id, 'number', CAST(TRY_CAST(nullif(regexp_extract(url, '(\\d+)\\D*$', 1), '') AS BIGINT) AS VARCHAR), 'no number' FROM ok)
UNION ALL SELECT page_id, 'load', NULL, lost FROM p WHERE lost IS NOT NULL"""


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests in two batches: a user's number is the key of some, the content is a number, the type the configuration.

    A chain of keys and contents is followed in order, which SQL cannot; the tests run requests one by one.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = e.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 != 0, F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string"))).alias("key"),
        F.concat_ws("/", "props", (F.col("user_id") % 40).cast("string")).alias("content"), F.col("event_type").alias("config"),
    )
    half = F.col("ord") % 2
    jobs = spark.createDataFrame([], "job_id string, key string, content string, config string, status string, ord long")
    first = requests.submit(made.filter(half == 0), jobs)
    second = requests.submit(made.filter(half == 1), requests.with_created(jobs, made.filter(half == 0), first))
    return first.unionByName(second)


QUERIES = {"p6_merged_items": merged_items, "p7_two_waves": two_waves, "k10_ledger": failures, "d8_requests": submitted}
ORACLE_SQL = {"p6_merged_items": MERGED_SQL, "p7_two_waves": WAVES_SQL, "k10_ledger": FAILURES_SQL}
