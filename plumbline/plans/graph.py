"""The property graph on the star tables, its queries, gates and domain rules.

Nodes: customers, orders, parts, suppliers and nations; edges: PLACED_BY, HAS_MATERIAL, SUPPLIED_BY, LOCATED_IN.
Nodes are upserted by id and edges by (source, target, relationship); the last one wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import dealt, stored


#: Nodes and ends of edges that a task counts at most.
ENDS = 2_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, col: str):
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


_NODE_OF = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey"}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_type, key; a node's id is both, put together only where it is shown."""
    return reduce(DataFrame.unionByName, [_t(spark, sf_dir, t).select(F.lit(t).alias("node_type"), F.col(c).cast("long").alias("key")) for t, c in _NODE_OF.items()])


def _shown(kind: str, key: str):
    return F.concat_ws(":", kind, F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """source_type, source, relationship, target_type, target, weight; all edges, or those of the ``wanted`` relationships.

    An edge comes with many lines, of which the last one's quantity stays: an aggregate that is combined before the shuffle.
    """
    line = _t(spark, sf_dir, "lineitem")
    last = F.max(F.struct("l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice"))["l_quantity"]

    def made(df: DataFrame, relationship: str, source: tuple[str, str], target: tuple[str, str], weight=None) -> DataFrame:
        keys = [F.lit(source[0]).alias("source_type"), F.col(source[1]).cast("long").alias("source"), F.lit(relationship).alias("relationship"), F.lit(target[0]).alias("target_type"), F.col(target[1]).cast("long").alias("target")]
        return df.select(*keys, F.lit(1.0).alias("weight")) if weight is None else df.groupBy(source[1], target[1]).agg(weight.alias("weight")).select(*keys, "weight")

    parts = {
        "HAS_MATERIAL": lambda r: made(line, r, ("orders", "l_orderkey"), ("part", "l_partkey"), last), "SUPPLIED_BY": lambda r: made(line, r, ("part", "l_partkey"), ("supplier", "l_suppkey"), last),
        "PLACED_BY": lambda r: made(_t(spark, sf_dir, "orders"), r, ("orders", "o_orderkey"), ("customer", "o_custkey")),
        "LOCATED_IN": lambda r: made(_t(spark, sf_dir, "customer"), r, ("customer", "c_custkey"), ("nation", "c_nationkey")).unionByName(made(_t(spark, sf_dir, "supplier"), r, ("supplier", "s_suppkey"), ("nation", "s_nationkey"))),
    }
    return reduce(DataFrame.unionByName, [of(r) for r, of in parts.items() if not wanted or r in wanted])


_NODES = "(" + " UNION ALL ".join(f"SELECT '{t}:' || {c} AS id, '{t}' AS node_type FROM {t}" for t, c in _NODE_OF.items()) + ")"
_LINES = "(SELECT 'orders:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id, 'HAS_MATERIAL' AS relationship, * FROM lineitem UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', * FROM lineitem)"
_EDGES = f"""(SELECT source_id, target_id, relationship, l_quantity AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relationship ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM {_LINES}) WHERE r = 1
 UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY', 1.0 FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', 1.0 FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 1.0 FROM supplier)"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).groupBy(F.concat(F.lit("node/"), "node_type").alias("what")).agg(F.count("*").alias("n"))
    e = edges(spark, sf_dir).groupBy(F.concat(F.lit("edge/"), "relationship").alias("what")).agg(F.count("*").alias("n"))
    return n.unionByName(e)


STATS_SQL = f"SELECT 'node/' || node_type AS what, count(*) AS n FROM {_NODES} GROUP BY 1 UNION ALL SELECT 'edge/' || relationship, count(*) FROM {_EDGES} GROUP BY 1"


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir, "SUPPLIED_BY").select(_shown("source_type", "source").alias("source_id"), _shown("target_type", "target").alias("target_id"), "relationship", "weight")


def full_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer, materials and where the customer is: joins of two hops."""
    orders = nodes(spark, sf_dir).filter("node_type = 'orders'")
    placed = edges(spark, sf_dir, "PLACED_BY").select("source", F.col("target").alias("_c"))
    materials = edges(spark, sf_dir, "HAS_MATERIAL").groupBy("source").agg(F.count("*").alias("materials"))
    where = edges(spark, sf_dir, "LOCATED_IN").filter("source_type = 'customer'").select(F.col("source").alias("_c"), F.concat(F.lit("nation:"), F.col("target").cast("string")).alias("nation"))
    out = placed.join(materials, "source", "full").join(where, "_c", "left")
    j = orders.join(out, orders["key"] == out["source"], "left")
    return j.select(_shown("node_type", "key").alias("id"), F.col("source").isNotNull().alias("found"), F.when(F.col("_c").isNotNull(), _id("customer", "_c")).alias("customer"), F.coalesce("materials", F.lit(0)).alias("materials"), "nation")


FULL_SQL = f"""SELECT id, s IS NOT NULL AS found, customer, coalesce(materials, 0) AS materials, nation FROM (SELECT id FROM {_NODES} WHERE node_type = 'orders')
 LEFT JOIN (SELECT source_id AS s, max(CASE WHEN relationship = 'PLACED_BY' THEN target_id END) AS customer, count(*) FILTER (relationship = 'HAS_MATERIAL') AS materials FROM {_EDGES} WHERE relationship IN ('PLACED_BY', 'HAS_MATERIAL') GROUP BY 1) ON id = s
 LEFT JOIN (SELECT source_id AS c, target_id AS nation FROM {_EDGES} WHERE relationship = 'LOCATED_IN') ON customer = c"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without materials, parts that nothing refers to, and isolated nodes."""
    n = nodes(spark, sf_dir)
    ends = lambda e, side: e.select(F.col(f"{side}_type").alias("node_type"), F.col(side).alias("key")).distinct()
    e = stored(edges(spark, sf_dir), "edges")
    lone = lambda df, used, what: df.join(used, ["node_type", "key"], "left_anti").select(_shown("node_type", "key").alias("id"), F.lit(what).alias("what"))
    parts = [
        lone(n.filter("node_type = 'orders'"), ends(e.filter("relationship = 'HAS_MATERIAL'"), "source"), "no_material"), lone(n.filter("node_type = 'part'"), ends(e, "target"), "not_referenced"),
        lone(n, ends(e, "source").unionByName(ends(e, "target")), "isolated"),
    ]
    return reduce(DataFrame.unionByName, parts)


ORPHANS_SQL = f"""WITH n AS (SELECT * FROM {_NODES}), e AS (SELECT * FROM {_EDGES}) SELECT id, 'no_material' AS what FROM n WHERE node_type = 'orders' AND id NOT IN (SELECT source_id FROM e WHERE relationship = 'HAS_MATERIAL')
 UNION ALL SELECT id, 'not_referenced' FROM n WHERE node_type = 'part' AND id NOT IN (SELECT target_id FROM e) UNION ALL SELECT id, 'isolated' FROM n WHERE id NOT IN (SELECT source_id FROM e UNION ALL SELECT target_id FROM e)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of nodes of a type with an outgoing edge, and whether it passes 0.9.

    Which edges stand for the same lines does not matter here: the ends of all rows are counted with the nodes, in one pass.
    """
    source = lambda t, kind, c: _t(spark, sf_dir, t).select(F.lit(kind).alias("node_type"), F.col(c).cast("long").alias("key"), F.lit(0).alias("_n")).filter("key IS NOT NULL")
    sources = [source("lineitem", "orders", "l_orderkey"), source("lineitem", "part", "l_partkey"), source("orders", "orders", "o_orderkey"), source("customer", "customer", "c_custkey"), source("supplier", "supplier", "s_suppkey")]
    seen = reduce(DataFrame.unionByName, sources, nodes(spark, sf_dir).withColumn("_n", F.lit(1)))
    each = dealt(seen, ENDS, ["node_type", "key"]).groupBy("node_type", "key").agg(F.sum("_n").alias("n"), (F.min("_n") == 0).alias("used"))
    j = each.groupBy("node_type").agg(F.sum("n").alias("nodes"), F.coalesce(F.sum(F.when(F.col("used"), F.col("n"))), F.lit(0).cast("long")).alias("resolved")).filter("nodes > 0")
    return j.withColumn("rate", F.col("resolved") / F.col("nodes")).withColumn("passed", F.col("rate") >= 0.9)


RATES_SQL = f"SELECT node_type, count(*) AS nodes, count(s) AS resolved, count(s) / count(*) AS rate, count(s) / count(*) >= 0.9 AS passed FROM {_NODES} LEFT JOIN (SELECT DISTINCT source_id AS s FROM {_EDGES}) ON id = s GROUP BY node_type"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each gate: name, passed, metric; a rule without rows is skipped, not passed."""
    l = _t(spark, sf_dir, "labels")  # noqa: E741
    one = l.agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("q"), F.avg((F.col("toxic") == 0).cast("double")).alias("c"))
    gate = lambda name, m, least: F.struct(F.lit(name).alias("name"), F.when(F.col("n") == 0, "skipped").when(m >= least, "passed").otherwise("failed").alias("result"), m.cast("decimal(20,9)").cast("double").alias("metric"))
    return one.select(F.explode(F.array(gate("rows", F.col("n").cast("double"), 1), gate("quality_rate", F.col("q"), 0.9), gate("clean_rate", F.col("c"), 0.8))).alias("g")).select("g.*")


GATES_SQL = """WITH o AS (SELECT count(*) AS n, avg(quality) AS q, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0 END) AS c FROM labels), g AS (SELECT n, 'rows' AS name, n::DOUBLE AS metric, 1 AS least FROM o UNION ALL SELECT n, 'quality_rate', q, 0.9 FROM o UNION ALL SELECT n, 'clean_rate', c, 0.8 FROM o)
SELECT name, CASE WHEN n = 0 THEN 'skipped' WHEN metric >= least THEN 'passed' ELSE 'failed' END AS result, CAST(CAST(metric AS DECIMAL(20,9)) AS DOUBLE) AS metric FROM g"""


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of confidences; null measures on no rows."""
    c = _t(spark, sf_dir, "lineitem").select((1 - F.col("l_discount")).alias("c"))
    return c.agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count_if(F.col("c") >= 0.999).alias("sure"), F.count_if((F.col("c") >= 0.9) & (F.col("c") < 0.999)).alias("likely"), F.count_if(F.col("c") < 0.9).alias("rest"))


CONFIDENCE_SQL = "SELECT min(c) AS least, max(c) AS most, count(*) FILTER (c >= 0.999) AS sure, count(*) FILTER (c >= 0.9 AND c < 0.999) AS likely, count(*) FILTER (c < 0.9) AS rest FROM (SELECT 1 - l_discount AS c FROM lineitem)"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed title blocks (orders) against the registry (customers): outer join with flags that are never null."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("number"), (F.col("o_custkey") % 3).alias("seen"))
    c = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey")
    j = o.join(c, o["number"] == c["c_custkey"], "left")
    return j.select("o_orderkey", F.col("c_custkey").isNotNull().alias("in_registry"), F.coalesce(F.col("seen") == F.col("c_nationkey") % 3, F.lit(False)).alias("agrees"), F.col("c_nationkey").alias("nation"))


REGISTRY_SQL = "SELECT o_orderkey, c_custkey IS NOT NULL AS in_registry, coalesce(o_custkey % 3 = c_nationkey % 3, false) AS agrees, c_nationkey AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"

QUERIES = {"a9_graph_stats": stats, "g0_edge_upsert": edge_upsert, "g2_full_spec": full_spec, "g4_orphans": orphans, "a10_rates": rates, "a11_gates": gates, "a13_confidence": confidence, "j3_registry": registry}
ORACLE_SQL = {"a9_graph_stats": STATS_SQL, "g0_edge_upsert": f"SELECT * FROM {_EDGES} WHERE relationship = 'SUPPLIED_BY'", "g2_full_spec": FULL_SQL, "g4_orphans": ORPHANS_SQL, "a10_rates": RATES_SQL, "a11_gates": GATES_SQL, "a13_confidence": CONFIDENCE_SQL, "j3_registry": REGISTRY_SQL}
