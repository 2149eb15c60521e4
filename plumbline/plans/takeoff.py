"""Quantities on the star tables: items, counts, areas, verdicts and their reconciliation.

lineitem stands for plan counts: a symbol is l_partkey, a sheet l_suppkey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import joins, ordered
from plumbline.plans.schedules import _ITEMS, items


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id, sheet_page, count, verified, confidence of each symbol and sheet."""
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("sheet_page")).agg(F.count("*").alias("count"), F.min(F.col("l_returnflag") != "R").alias("verified"), F.min("l_discount").alias("confidence"))


_COUNTS = "(SELECT l_partkey AS symbol_id, l_suppkey AS sheet_page, count(*) AS count, bool_and(l_returnflag <> 'R') AS verified, min(l_discount) AS confidence FROM lineitem GROUP BY 1, 2)"


def fixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = symbol_counts(spark, sf_dir)
    return c.groupBy("symbol_id").agg(F.sum("count").alias("total"), F.countDistinct("sheet_page").alias("sheets"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("sheet_page")), lambda x: x.cast("string"))).alias("sheet_list"))


FIXTURE_SQL = f"SELECT symbol_id, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT sheet_page) AS sheets, string_agg(CAST(sheet_page AS VARCHAR), ',' ORDER BY sheet_page) AS sheet_list FROM {_COUNTS} GROUP BY symbol_id"


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = symbol_counts(spark, sf_dir)
    return c.groupBy("symbol_id").agg(F.max("count").alias("building_total"), F.min("verified").alias("verified"), F.min("confidence").alias("confidence"), (F.countDistinct("count") > 1).alias("disagreement"))


RECONCILE_SQL = f"SELECT symbol_id, max(count) AS building_total, bool_and(verified) AS verified, min(confidence) AS confidence, count(DISTINCT count) > 1 AS disagreement FROM {_COUNTS} GROUP BY symbol_id"


def flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog items of unknown count; verified totals flip them."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("mark"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), F.when(F.col("p_size") > 5, "unknown_plan_count").otherwise("row_count").alias("quantity_basis"))
    return joins.flip(part, reconcile(spark, sf_dir))


FLIP_SQL = f"""SELECT mark, CASE WHEN hit THEN CAST(t AS DOUBLE) END AS quantity, CASE WHEN hit THEN 'EA' END AS unit, CASE WHEN hit THEN 'plan_count' ELSE quantity_basis END AS quantity_basis FROM
 (SELECT *, quantity_basis = 'unknown_plan_count' AND t IS NOT NULL AS hit FROM (SELECT p_partkey AS mark, CASE WHEN p_size > 5 THEN 'unknown_plan_count' ELSE 'row_count' END AS quantity_basis FROM part)
 LEFT JOIN (SELECT symbol_id, building_total AS t FROM ({RECONCILE_SQL}) WHERE verified) ON mark = symbol_id)"""


def double_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_counts(spark, sf_dir).groupBy("symbol_id").agg(F.count("*").alias("pages"), F.sum("count").alias("total")).filter("pages >= 2")


DOUBLE_SQL = f"SELECT symbol_id, count(*) AS pages, CAST(sum(count) AS BIGINT) AS total FROM {_COUNTS} GROUP BY symbol_id HAVING count(*) >= 2"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part type: marks, and how many are counted on a plan or not."""
    part = _t(spark, sf_dir, "part").select("p_type", "p_partkey")
    seen = _t(spark, sf_dir, "lineitem").select("l_partkey").distinct().withColumn("seen", F.lit(1))
    j = part.join(seen, part["p_partkey"] == seen["l_partkey"], "left")
    return j.groupBy("p_type").agg(F.count("*").alias("types"), F.count("seen").alias("counted"), F.count_if(F.col("seen").isNull()).alias("uncounted"))


CATALOG_SQL = "SELECT p_type, count(*) AS types, count(l_partkey) AS counted, count(*) FILTER (l_partkey IS NULL) AS uncounted FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey GROUP BY p_type"


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as positions: every third vector of a block of 64 ids is a label, the others are rooms."""
    v = _t(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("page"), "vec_id", (F.element_at("embedding", 1).cast("double") * 100).alias("x"), (F.element_at("embedding", 2).cast("double") * 100).alias("y"))
    labels = v.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "label_ord")
    return joins.nearest_within(labels, v.filter("vec_id % 3 <> 0").withColumnRenamed("vec_id", "room_ord"), ["page"], 10.0).select("page", "label_ord", "room_ord")


NEAREST_SQL = """WITH v AS (SELECT vec_id // 64 AS page, vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings),
p AS (SELECT l.page, l.vec_id AS label_ord, r.vec_id AS room_ord, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM v l JOIN v r USING (page) WHERE l.vec_id % 3 = 0 AND r.vec_id % 3 <> 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, label_ord ORDER BY d, room_ord) AS i FROM p WHERE d <= 10) WHERE i = 1)
SELECT page, label_ord, room_ord FROM (SELECT *, row_number() OVER (PARTITION BY page, room_ord ORDER BY d, label_ord) AS j FROM b) WHERE j = 1"""


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets classified by how far their points lie apart: sparse, instance_plan or legend_block."""
    v = _t(spark, sf_dir, "embeddings").select("label", (F.floor(F.col("vec_id") / 16)).alias("sheet"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    s = v.groupBy("label", "sheet").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    return s.select("label", "sheet", F.when(F.col("n") < 3, "sparse").when(F.greatest("dx", "dy") >= 0.35, "instance_plan").otherwise("legend_block").alias("kind"))


SPREAD_SQL = """SELECT label, sheet, CASE WHEN n < 3 THEN 'sparse' WHEN greatest(dx, dy) >= 0.35 THEN 'instance_plan' ELSE 'legend_block' END AS kind FROM
 (SELECT label, vec_id // 16 AS sheet, count(*) AS n, max(CAST(embedding[1] AS DOUBLE)) - min(CAST(embedding[1] AS DOUBLE)) AS dx, max(CAST(embedding[2] AS DOUBLE)) - min(CAST(embedding[2] AS DOUBLE)) AS dy FROM embeddings GROUP BY 1, 2)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of orders with any line, as count, covered count and share."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey").distinct()
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()  # noqa: E741
    j = o.join(l, o["o_orderkey"] == l["k"], "left").agg(F.count("*").alias("rooms"), F.count("k").alias("covered"))
    return j.select("rooms", "covered", F.when(F.col("rooms") > 0, F.col("covered") / F.col("rooms")).otherwise(0.0).alias("coverage"))


COVERAGE_SQL = "SELECT count(*) AS rooms, count(k) AS covered, CASE WHEN count(*) > 0 THEN count(k) / count(*) ELSE 0 END AS coverage FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as counts and their lines as verdicts: confidence after merging."""
    c = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("symbol_id"), (F.col("o_custkey") % 10).alias("count"), ((F.col("o_custkey") % 7) / 8.0).alias("confidence"))
    v = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("symbol_id")).agg(F.max(F.col("l_returnflag") == "A").alias("verified"), F.min(F.col("l_linestatus") == "F").alias("agrees"), F.max("l_tax").alias("confidence"))
    return joins.merge_verdicts(c, v, ["symbol_id"]).select("symbol_id", "count", F.col("confidence").cast("decimal(12,6)").cast("double").alias("confidence"), "verified")


VERDICTS_SQL = """SELECT symbol_id, count, CAST(CAST(CASE WHEN NOT coalesce(v, false) THEN confidence WHEN a THEN greatest(confidence, c) ELSE round(least(confidence, c) * 0.5, 3) END AS DECIMAL(12,6)) AS DOUBLE) AS confidence, coalesce(v, false) AS verified FROM
 (SELECT o_orderkey AS symbol_id, o_custkey % 10 AS count, (o_custkey % 7) / 8.0::DOUBLE AS confidence FROM orders) LEFT JOIN (SELECT l_orderkey AS k, bool_or(l_returnflag = 'A') AS v, bool_and(l_linestatus = 'F') AS a, max(l_tax) AS c FROM lineitem GROUP BY 1) ON symbol_id = k"""


def quantity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by basis: a numeric quantity, else one for each instance row, else unknown."""
    i = items(spark, sf_dir)
    basis = F.when(F.col("l_quantity") > 10, "qty_column").when(F.col("l_linestatus") == "O", "row_count").otherwise("unknown_plan_count")
    q = F.when(basis == "qty_column", F.col("l_quantity")).when(basis == "row_count", 1.0)
    return i.select(basis.alias("quantity_basis"), q.alias("q")).groupBy("quantity_basis").agg(F.count("*").alias("items"), F.sum("q").alias("quantity"))


QUANTITY_SQL = f"""SELECT quantity_basis, count(*) AS items, sum(CASE quantity_basis WHEN 'qty_column' THEN l_quantity WHEN 'row_count' THEN 1.0::DOUBLE END) AS quantity FROM
 (SELECT *, CASE WHEN l_quantity > 10 THEN 'qty_column' WHEN l_linestatus = 'O' THEN 'row_count' ELSE 'unknown_plan_count' END AS quantity_basis FROM {_ITEMS}) GROUP BY quantity_basis"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of 100 of the filtered, sorted items."""
    return ordered.page_of(items(spark, sf_dir).filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], 3, 100)


PAGED_SQL = f"SELECT l_orderkey, l_linenumber, l_quantity FROM {_ITEMS} WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber LIMIT 100 OFFSET 200"


def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results of shards in order, first wins: shards are ship months, keys are parts."""
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mark"), F.month("l_shipdate").alias("shard_index"), "l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    return ordered.first_wins(l, ["mark"], [F.col(c) for c in ("shard_index", "l_orderkey", "l_linenumber", "l_quantity")])


MERGED_SQL = "SELECT mark, shard_index, l_orderkey, l_linenumber, l_quantity FROM (SELECT l_partkey AS mark, CAST(month(l_shipdate) AS INTEGER) AS shard_index, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY month(l_shipdate), l_orderkey, l_linenumber, l_quantity) AS r FROM lineitem) WHERE r = 1"

QUERIES = {
    "a2_fixture_summary": fixture_summary, "a4_reconcile": reconcile, "j17_flip": flipped, "a18_double_counts": double_counts, "a17_catalog": catalog, "j4_nearest": nearest, "f30_spread": spread,
    "a5_coverage": coverage, "j18_verdicts": verdicts, "r5_quantity_rule": quantity_rule, "d12_page": paged, "d2_merge_shards": merged_shards,
}
ORACLE_SQL = {
    "a2_fixture_summary": FIXTURE_SQL, "a4_reconcile": RECONCILE_SQL, "j17_flip": FLIP_SQL, "a18_double_counts": DOUBLE_SQL, "a17_catalog": CATALOG_SQL, "j4_nearest": NEAREST_SQL, "f30_spread": SPREAD_SQL,
    "a5_coverage": COVERAGE_SQL, "j18_verdicts": VERDICTS_SQL, "r5_quantity_rule": QUANTITY_SQL, "d12_page": PAGED_SQL, "d2_merge_shards": MERGED_SQL,
}
