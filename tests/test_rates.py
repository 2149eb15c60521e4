"""Nodes with an outgoing edge: repeated nodes, null keys and ends that are no nodes; and tasks by the number of ends."""

import compare
from pyspark.sql import functions as F

from plumbline.plans import graph


def test_rates(spark, tmp_path, monkeypatch):
    for t in compare.TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "part":
            df = df.unionByName(df.limit(5)).unionByName(df.limit(1).withColumn("p_partkey", F.lit(None).cast("long")))
        if t == "lineitem":
            df = df.filter("l_partkey % 3 > 0").withColumn("l_partkey", F.when(F.col("l_linenumber") < 7, F.col("l_partkey")))
        df.coalesce(1).write.parquet(f"{tmp_path}/made/{t}")
        (file,) = (tmp_path / "made" / t).glob("*.parquet")
        file.rename(tmp_path / f"{t}.parquet")
    monkeypatch.setattr(graph, "ENDS", 100)
    got = graph.rates(spark, str(tmp_path))
    assert compare.spark_rows(got) == compare.oracle(graph.RATES_SQL, str(tmp_path))
    # The ends are shuffled once, to as many tasks as their number asks for.
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
