"""Tables of schedules on the driver's tables: columns by their headers, rows by their keys, and what they sum up to.

Ten orders are a table, one of the seven kinds by its number: a title row, a header row and a row for each order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import schema_resolver as R
from plumbline.operators.ordered import first_wins


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Headers of the made tables, and the field that each column should be (for SQL).
_HEADERS = {
    "door": (("MARK", "Width", "Height", "Door\nMaterial", "HARDWARE SET", "Colour"), ("door_mark", "width", "height", "door_material", "hardware_set", None)),
    "finish": (("Room No.", "NAME", "FLOOR", "BASE", "Walls", "CEILING"), ("room_number", "room_name", "floor_finish", "base_finish", "wall_finish", "ceiling_finish")),
    "plumbing_fixture": (("TAG", "DESCRIPTION", "QTY", "MFR", "MODEL NO.", "NOTES"), ("fixture_tag", "description", "quantity", "manufacturer", "model", "remarks")),
    "window": (("MARK", "TYPE", "SIZE", "GLASS AREA", "NOTES", "Sill"), ("mark", "window_type", "size", "daylight_area", "notes", None)),
    "lighting_fixture": (("TYPE", "DESCRIPTION", "MANUFACTURER", "CATALOG NO", "LAMPS", "DRIVER"), ("fixture_tag", "description", "manufacturer", "model", "lamp", "driver")),
    "camera": (("DEVICE NUMBER", "ROOM NUMBER", "ROOM NAME", "CAMERA TYPE", "MAKE & MODEL", "REFERENCE DETAIL"), ("device_number", "room_number", "room_name", "camera_type", "make_model", "reference")),
    "security_device": (("DEVICE NUMBER", "ROOM NUMBER", "ROOM NAME", "DEVICE TYPE", "MAKE", "REFERENCE"), ("device_number", "room_number", "room_name", "device_type", "make", "reference")),
}
_TABLE = "CAST((o_orderkey - o_orderkey % 10) / 10 AS BIGINT)"
_KEY = (
    f"CASE {_TABLE} % 7 WHEN 0 THEN CASE WHEN {_TABLE} % 3 = 0 THEN 'B' || CAST(o_custkey % 100 + 10 AS STRING) ELSE 'N' || CAST(o_custkey % 900 + 100 AS STRING) || 'A' END WHEN 1 THEN CASE WHEN o_custkey % 4 = 0 THEN 'LEVEL ONE' ELSE 'S' || CAST(o_custkey % 300 + 100 AS STRING) END "
    "WHEN 2 THEN 'WC-' || CAST(o_custkey % 5 AS STRING) WHEN 3 THEN CASE WHEN o_custkey % 3 = 0 THEN 'Type' ELSE 'W' || CAST(o_custkey % 40 AS STRING) END WHEN 4 THEN 'L' || CAST(o_custkey % 6 AS STRING) || 'A' WHEN 5 THEN CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'C-EXTERIOR-' || CAST(o_custkey AS STRING) END ELSE 'ACP-N124-' || CAST(o_custkey AS STRING) END"
)
_VALUES = (_KEY, "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END", "CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 50 AS STRING) || ' ea' ELSE '' END", "o_orderstatus", "CASE WHEN o_custkey % 7 = 0 THEN 'N/A' ELSE 'HW-' || CAST(o_custkey % 9 AS STRING) END", "''")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, kind, row_ord, col_ord, text."""
    # A table's number tells its kind, so no join is needed, and a query of one kind makes only that kind's cells.
    kind = F.element_at(F.array(*(F.lit(k) for k in _HEADERS)), (F.col("table_id") % 7 + 1).cast("int"))
    o = _t(spark, sf_dir, "orders").withColumn("table_id", F.expr(_TABLE)).withColumn("kind", kind)
    data = o.select("table_id", "kind", (F.col("o_orderkey") % 10 + 2).cast("int").alias("row_ord"), F.posexplode(F.array(*(F.expr(v) for v in _VALUES))).alias("col_ord", "text"))
    header = F.element_at(F.create_map(*(x for k, (h, _) in _HEADERS.items() for x in (F.lit(k), F.array(*map(F.lit, h))))), F.col("kind"))
    title = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i == 0, F.concat(F.upper("kind"), F.lit(" SCHEDULE"))).otherwise(""))
    top = o.select("table_id").distinct().withColumn("kind", kind).select("table_id", "kind", F.explode(F.array(F.struct(F.lit(0).alias("r"), title.alias("t")), F.struct(F.lit(1).alias("r"), header.alias("t")))).alias("x"))
    heads = top.select("table_id", "kind", F.col("x.r").alias("row_ord"), F.posexplode("x.t").alias("col_ord", "text"))
    return data.unionByName(heads).select("table_id", "row_ord", "col_ord", "text", "kind")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of every column, and the share of the schema's core fields that its table has."""
    tables = R.resolved(R.table_rows(cells(spark, sf_dir), ["table_id"]), ["table_id"])
    return tables.select("table_id", "kind", "data_start", "coverage", F.inline("columns")).drop("label")


_VALUES_SQL = "(VALUES " + ", ".join(f"({i}, '{k}', {j}, {repr(f) if f else 'NULL'})" for i, (k, (_, fields)) in enumerate(_HEADERS.items()) for j, f in enumerate(fields)) + ") v(n, kind, col_ord, field)"
COLUMNS_SQL = f"SELECT table_id, kind, col_ord, field, 2 AS data_start, 1.0::DOUBLE AS coverage FROM (SELECT DISTINCT {_TABLE} AS table_id FROM orders) JOIN {_VALUES_SQL} ON table_id % 7 = n"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all schedules: mark, quantity, unit and basis, with the number of attributes that are filled."""
    rows = R.table_items(cells(spark, sf_dir), ["table_id"])
    filled = F.size(F.filter(F.map_values("attributes"), lambda v: v != ""))
    return rows.select("table_id", "kind", "row_ord", "mark", "quantity", "quantity_basis", filled.alias("filled"))


_DATA = "(SELECT " + f"{_TABLE} AS table_id, {_TABLE} % 7 AS n, CAST(o_orderkey % 10 + 2 AS INTEGER) AS row_ord, " + ", ".join(f"{v} AS v{i}" for i, v in enumerate(_VALUES)) + " FROM orders)"
_ITEMS = f"""(WITH d AS (SELECT *, (CASE WHEN v0 <> '' THEN 1 ELSE 0 END) + (CASE WHEN v1 <> '' THEN 1 ELSE 0 END) + (CASE WHEN v2 <> '' THEN 1 ELSE 0 END) + 2 AS f FROM {_DATA}),
b AS (SELECT *, count(*) FILTER (CASE n WHEN 0 THEN regexp_full_match(v0, '[NS][A-Z]?\\d{{2,}}[A-Z]{{0,2}}') ELSE regexp_full_match(v0, '[NS]\\d{{3}}[A-Z]?') END) OVER (PARTITION BY table_id) >= 5 AS built FROM d),
k AS (SELECT *, CASE WHEN n IN (5, 6) THEN v0 <> '' WHEN n IN (2, 3, 4) THEN regexp_full_match(v0, '[A-Z]|[A-Z]{{1,4}}-?\\d+[A-Z]?') WHEN built AND n = 0 THEN regexp_full_match(v0, '[NS][A-Z]?\\d{{2,}}[A-Z]{{0,2}}') WHEN built THEN regexp_full_match(v0, '[NS]\\d{{3}}[A-Z]?') ELSE regexp_full_match(v0, '[A-Za-z0-9]{{2,8}}') AND regexp_matches(v0, '\\d') END AS good FROM b),
g AS (SELECT *, row_number() OVER (PARTITION BY table_id, CASE WHEN n IN (2, 3, 4) THEN v0 ELSE CAST(row_ord AS VARCHAR) END ORDER BY row_ord) AS r FROM k WHERE good)
SELECT table_id, ['door', 'finish', 'plumbing_fixture', 'window', 'lighting_fixture', 'camera', 'security_device'][n + 1] AS kind, row_ord, v0 AS mark, CASE WHEN n IN (0, 1, 5, 6) THEN 1.0 WHEN n = 2 AND v2 <> '' THEN CAST(regexp_extract(v2, '\\d+') AS DOUBLE) END AS quantity,
 CASE WHEN n IN (0, 1, 5, 6) THEN 'row_count' WHEN n = 2 AND v2 <> '' THEN 'qty_column' ELSE 'unknown_plan_count' END AS quantity_basis, CAST(f AS INTEGER) AS filled, v1, v3, v4 FROM g WHERE r = 1)"""


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of door schedules: mark, size, material, hardware and the building that its first letter tells."""
    c = cells(spark, sf_dir).filter("kind = 'door'")
    a = lambda f: F.coalesce(F.try_element_at("attributes", F.lit(f)), F.lit(""))
    building = F.when(F.startswith("mark", F.lit("N")), "North").when(F.startswith("mark", F.lit("S")), "South").otherwise("")
    return R.table_items(c, ["table_id"], (R.DOOR,)).select("table_id", "row_ord", "mark", a("width").alias("width"), a("door_material").alias("door_material"), a("hardware_set").alias("hardware_set"), building.alias("building"))


DOORS_SQL = f"SELECT table_id, row_ord, mark, v1 AS width, v3 AS door_material, v4 AS hardware_set, CASE substr(mark, 1, 1) WHEN 'N' THEN 'North' WHEN 'S' THEN 'South' ELSE '' END AS building FROM {_ITEMS} WHERE kind = 'door'"


def door_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a door schedule's extraction is: the mean of the share of regular marks and of filled width and material."""
    d = doors(spark, sf_dir)
    from plumbline.functions.text import is_door_mark

    return d.groupBy("table_id").agg(F.round((F.avg(is_door_mark(F.col("mark")).cast("double")) + F.avg(((F.col("width") != "") & (F.col("door_material") != "")).cast("double"))) / 2, 3).alias("confidence"))


CONFIDENCE_SQL = f"SELECT table_id, round((avg(CASE WHEN regexp_full_match(mark, '[NS][A-Z]?\\d{{2,}}[A-Z]{{0,2}}') THEN 1.0::DOUBLE ELSE 0 END) + avg(CASE WHEN width <> '' AND door_material <> '' THEN 1.0::DOUBLE ELSE 0 END)) / 2, 3) AS confidence FROM ({DOORS_SQL}) GROUP BY table_id"


def finish_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of all finish schedules, the first of each number."""
    c = cells(spark, sf_dir).filter("kind = 'finish'")
    a = lambda f: F.coalesce(F.try_element_at("attributes", F.lit(f)), F.lit(""))
    rows = R.table_items(c, ["table_id"], (R.FINISH,))
    return first_wins(rows, ["mark"], [F.asc("table_id"), F.asc("row_ord")]).select("mark", "table_id", "row_ord", a("room_name").alias("room_name"), a("base_finish").alias("base_finish"))


ROOMS_SQL = f"SELECT mark, table_id, row_ord, v1 AS room_name, v3 AS base_finish FROM (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY table_id, row_ord) AS i FROM {_ITEMS} WHERE kind = 'finish') WHERE i = 1"


def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 50 tables, all taken for door schedules, the best one and its coverage."""
    c = cells(spark, sf_dir).drop("kind")
    _, tables = R.resolve(c, R.DOOR, ["table_id"])
    return R.best_table(tables.withColumn("page", F.floor(F.col("table_id") / 50)), ["page"], "table_id").select("page", "table_id", "coverage")


BEST_SQL = f"SELECT table_id // 50 AS page, min(table_id) AS table_id, 1.0::DOUBLE AS coverage FROM (SELECT DISTINCT {_TABLE} AS table_id FROM orders) WHERE table_id % 7 = 0 GROUP BY 1"


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name several doors at once, one row for each: values that divide are dealt, others go to the first."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'N1A N1B' ELSE 'S' || CAST(o_custkey AS STRING) END").alias("mark"), F.expr("'3 4'").alias("size"), F.col("o_orderpriority").alias("note"))
    return R.expand_merged(rows, "mark", ["size", "note"]).select("o_orderkey", "mark", "size", "note")


MERGED_SQL = """SELECT o_orderkey, 'N1A' AS mark, '3' AS size, CASE WHEN len(string_split(o_orderpriority, ' ')) % 2 = 0 THEN array_to_string(string_split(o_orderpriority, ' ')[1:len(string_split(o_orderpriority, ' ')) // 2], ' ') ELSE o_orderpriority END AS note FROM orders WHERE o_custkey % 2 = 0
 UNION ALL SELECT o_orderkey, 'N1B', '4', CASE WHEN len(string_split(o_orderpriority, ' ')) % 2 = 0 THEN array_to_string(string_split(o_orderpriority, ' ')[len(string_split(o_orderpriority, ' ')) // 2 + 1:], ' ') ELSE '' END FROM orders WHERE o_custkey % 2 = 0
 UNION ALL SELECT o_orderkey, 'S' || o_custkey, '3 4', o_orderpriority FROM orders WHERE o_custkey % 2 = 1"""

QUERIES = {"r1_columns": columns, "r6_items": items, "r7_doors": doors, "a7_door_confidence": door_confidence, "d5_finish_rooms": finish_rooms, "d9_best_tables": best_tables, "r3_merged_rows": merged_rows}
ORACLE_SQL = {
    "r1_columns": COLUMNS_SQL, "r6_items": f"SELECT table_id, kind, row_ord, mark, quantity, quantity_basis, CASE WHEN kind IN ('door', 'window') THEN filled ELSE filled END AS filled FROM {_ITEMS}", "r7_doors": DOORS_SQL, "a7_door_confidence": CONFIDENCE_SQL,
    "d5_finish_rooms": ROOMS_SQL, "d9_best_tables": BEST_SQL, "r3_merged_rows": MERGED_SQL,
}
