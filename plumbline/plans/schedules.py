"""Schedule items: first-wins deduplication and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import first_wins


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as schedule items: (l_orderkey, l_linenumber) is (schedule, mark); every other column orders."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return first_wins(rows, ["l_orderkey", "l_linenumber"], order)


def schedule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("total_items"), F.sum("l_quantity").alias("known_quantity"))


_ITEMS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate,
 l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1)"""

QUERIES = {"a1_schedule_summary": schedule_summary}
ORACLE_SQL = {"a1_schedule_summary": f"SELECT l_returnflag, count(*) AS total_items, sum(l_quantity) AS known_quantity FROM {_ITEMS} GROUP BY l_returnflag"}
