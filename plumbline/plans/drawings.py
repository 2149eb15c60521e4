"""Drawing sheets on the driver's tables: positioned words, their kinds, labels, counts, scales, title blocks and indexes.

The words of sheets are made from ``events`` (a sheet is 24 ids), sheet lists from ``part``.  The expressions that make
them are the same text for Spark and for the SQL that the results are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import manuals, sheets
from plumbline.operators.ordered import first_wins


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_S = "CAST({} AS STRING)".format
_TEXT = (
    "CASE event_id % 12 WHEN 0 THEN " + _S("100 + event_id % 900") + " WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'S.F.' ELSE 'SF' END WHEN 2 THEN " + _S("event_id % 2000") + " || 'SF' WHEN 3 THEN 'N' || lpad("
    + _S("user_id % 1000") + ", 3, '0') WHEN 4 THEN 'S' || lpad(" + _S("event_id % 1000") + ", 3, '0') || 'A' WHEN 5 THEN 'A2.1.' || " + _S("user_id % 9") + " WHEN 6 THEN " + _S("event_id % 40")
    + " || '''-6\"' WHEN 7 THEN 'MECH ROOM' WHEN 8 THEN 'WC-' || " + _S("user_id % 4") + " WHEN 9 THEN 'L' || " + _S("user_id % 1500") + " WHEN 10 THEN ' N-' || " + _S("event_id % 10") + " ELSE CASE WHEN user_id % 2 = 0 THEN '  ' ELSE 'lower case' END END"
)
_WORD = {
    "page": "CAST((event_id - event_id % 24) / 24 AS BIGINT)", "pos": "event_id % 24", "text": _TEXT, "x0": "CAST(event_id * 37 % 1000 AS DOUBLE)", "x1": "CAST(event_id * 37 % 1000 + 8 + event_id % 5 AS DOUBLE)",
    "y0": "CAST(event_id * 91 % 800 AS DOUBLE)", "y1": "CAST(event_id * 91 % 800 + 4 + user_id % 7 AS DOUBLE)",
}
_WORDS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WORD.items()) + " FROM events)"
_POSITIONED = f"(SELECT page, pos, trim(text) AS text, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {_WORDS} WHERE trim(text) <> '')"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, text, x0, y0, x1, y1 of the words of all sheets."""
    return _t(spark, sf_dir, "events").select(*(F.expr(e).alias(n) for n, e in _WORD.items()))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("page", X.token_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


KINDS_SQL = f"""SELECT page, CASE WHEN t = '' THEN 'blank' WHEN regexp_full_match(t, '[NS]-[A-Z0-9]{{1,2}}|[A-K]|[1-8]') THEN 'grid_label' WHEN regexp_full_match(t, '[NS]\\d{{3}}[A-Z]?') THEN 'door_mark'
 WHEN regexp_full_match(t, '(SHEET\\s+)?[A-Z]{{1,3}}\\d+\\.\\d+(\\.\\d+)*') THEN 'sheet_reference' WHEN regexp_matches(t, '\\d+''') THEN 'dimension' WHEN regexp_full_match(t, '[A-Z][A-Z0-9 &/().\\-]{{2,}}') THEN 'room_name' ELSE 'unknown' END AS kind,
 count(*) AS n FROM (SELECT page, trim(text) AS t FROM {_WORDS}) GROUP BY ALL"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.positioned(words(spark, sf_dir)).select("page", "pos", "text", "x", "y")


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row-key grammars each word fits, and the number and the digits in it."""
    t = X.strip(F.col("text"))
    flags = {"tag": X.looks_like_tag(t), "mark": X.looks_like_mark(t), "door": X.is_door_mark(t), "room": X.is_room(t)}
    return words(spark, sf_dir).select("page", "pos", *(f.alias(n) for n, f in flags.items()), X.number(t).alias("number"), X.first_digits(t).alias("digits"))


KEYS_SQL = f"""SELECT page, pos, regexp_full_match(t, '[A-Z]|[A-Z]{{1,4}}-?\\d+[A-Z]?') AS tag, regexp_full_match(t, '[A-Za-z0-9]{{2,8}}') AND regexp_matches(t, '\\d') AS mark, regexp_full_match(t, '[NS][A-Z]?\\d{{2,}}[A-Z]{{0,2}}') AS door,
 regexp_full_match(t, '[NS]\\d{{3}}[A-Z]?') AS room, TRY_CAST(nullif(regexp_extract(t, '-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS number, TRY_CAST(nullif(regexp_extract(t, '\\d+'), '') AS INTEGER) AS digits FROM (SELECT page, pos, trim(text) AS t FROM {_WORDS})"""


def area_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.area_labels(sheets.positioned(words(spark, sf_dir)), ["page"])


_LABELS = f"""(SELECT page, pos, CAST(regexp_extract(text, '\\d+') AS DOUBLE) AS area, x, y FROM (SELECT *, lead(text) OVER (PARTITION BY page ORDER BY pos) AS following FROM {_POSITIONED})
 WHERE (regexp_full_match(text, '\\d+(\\.\\d+)?') AND following IN ('SF', 'S.F.')) OR regexp_full_match(text, '\\d+(\\.\\d+)?S\\.?F\\.?'))"""


def _rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.expr("'N' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')").alias("room_number")).distinct()


_ROOMS = "(SELECT DISTINCT 'N' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') AS room_number FROM customer WHERE c_acctbal > 0)"


def area_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sheets.positioned(words(spark, sf_dir))
    return sheets.area_plans(sheets.area_labels(w, ["page"]), w, _rooms(spark, sf_dir), ["page"], 2)


PLANS_SQL = f"""SELECT page, labels, rooms FROM (SELECT page, count(*) AS labels FROM {_LABELS} GROUP BY page) JOIN
 (SELECT page, count(*) AS rooms FROM {_POSITIONED} WHERE text IN (SELECT room_number FROM {_ROOMS}) GROUP BY page) USING (page) WHERE labels >= 2 AND rooms >= 2"""


def known_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are known rooms: a semi-join, repeated words stay."""
    rooms = _rooms(spark, sf_dir).withColumnRenamed("room_number", "text")
    return sheets.positioned(words(spark, sf_dir)).join(rooms, "text", "left_semi").select("page", "pos", "text")


KNOWN_SQL = f"SELECT page, pos, text FROM {_POSITIONED} WHERE text IN (SELECT room_number FROM {_ROOMS})"


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the catalog (a tag for each tenth part) on instance plans; every seventh sheet is excluded."""
    w = sheets.positioned(words(spark, sf_dir))
    tags = _t(spark, sf_dir, "part").select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'WC-' || CAST(p_partkey % 4 AS STRING) ELSE 'L' || CAST(p_partkey AS STRING) END").alias("tag"))
    pages = w.select("page").distinct().withColumn("width", F.lit(1000.0)).withColumn("height", F.lit(800.0))
    out = sheets.fixture_counts(w.select("page", "text", "x", "y"), tags, pages, ["page"], pages.filter("page % 7 = 0").select("page"), least=2)
    return out.select("page", "tag", "count", F.get(F.col("points"), 0)["x"].alias("first_x"))


TAGS_SQL = f"""WITH tag AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'WC-' || CAST(p_partkey % 4 AS STRING) ELSE 'L' || CAST(p_partkey AS STRING) END AS tag FROM part),
h AS (SELECT page, tag, x, y FROM {_POSITIONED} JOIN tag ON text = tag WHERE page % 7 <> 0), p AS (SELECT page FROM h GROUP BY page HAVING count(*) >= 2 AND greatest((max(x) - min(x)) / 1000, (max(y) - min(y)) / 800) >= 0.35)
SELECT page, tag, count(*) AS count, min(x) AS first_x FROM h WHERE page IN (SELECT page FROM p) GROUP BY page, tag"""


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("dx"), F.element_at("embedding", 2).cast("double").alias("dy"))
    return e.groupBy(X.snap_rotation(F.col("dx"), F.col("dy")).alias("rotation")).agg(F.count("*").alias("n"))


ROTATIONS_SQL = "SELECT CAST((CAST(round(degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE))) / 90) AS INTEGER) * 90 + 360) % 360 AS INTEGER) AS rotation, count(*) AS n FROM embeddings GROUP BY 1"


def point_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths (here the vectors' numbers, two by two, as points) flattened to bounding boxes."""
    points = F.transform(F.sequence(F.lit(0), F.size("embedding") - 2, F.lit(2)), lambda i: F.struct(F.get("embedding", i).alias("x"), F.get("embedding", i + 1).alias("y")))
    return _t(spark, sf_dir, "embeddings").select("vec_id", sheets.boxes(points).alias("b")).select("vec_id", "b.*")


BOXES_SQL = "SELECT vec_id, list_min([embedding[i] FOR i IN range(1, 64, 2)]) AS x0, list_min([embedding[i] FOR i IN range(2, 65, 2)]) AS y0, list_max([embedding[i] FOR i IN range(1, 64, 2)]) AS x1, list_max([embedding[i] FOR i IN range(2, 65, 2)]) AS y1 FROM embeddings"

_SCALE_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'SCALE: 1/' || CAST(o_custkey % 3 * 4 + 4 AS STRING) || '\" = 1''-0\"' WHEN 1 THEN 'PLAN 1 / 8 \" = 1′' WHEN 2 THEN '1\" = ' || CAST(o_custkey % 40 AS STRING) || '''' WHEN 3 THEN 'no scale' ELSE '0/8\" = 1''' END"


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of three texts each: the scale's factor, and what a sheet with one or several scales gets."""
    t = _t(spark, sf_dir, "orders").select(F.expr("CAST((o_orderkey - o_orderkey % 3) / 3 AS BIGINT)").alias("sheet"), "o_orderkey", F.expr(_SCALE_TEXT).alias("text"))
    out = sheets.sheet_scales(t, ["sheet"], "o_orderkey")
    return out.select("sheet", "factor", "confidence", "ambiguous", F.array_join("all_scales", ",").alias("all_scales"))


SCALES_SQL = f"""WITH t AS (SELECT CAST((o_orderkey - o_orderkey % 3) / 3 AS BIGINT) AS sheet, o_orderkey, {_SCALE_TEXT} AS text FROM orders), p AS (SELECT sheet, o_orderkey, regexp_extract(text, '\\d{{1,2}}(?:\\s*/\\s*\\d{{1,3}})?\\s*"\\s*=\\s*\\d{{1,3}}\\s*[''′]') AS s FROM t),
c AS (SELECT sheet, regexp_replace(s, '\\s+', '', 'g') AS c, min(o_orderkey) AS o FROM p WHERE s <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY o) AS r FROM c),
g AS (SELECT sheet, count(*) AS n, string_agg(c, ',' ORDER BY o) AS all_scales, max(CASE WHEN r = 1 THEN c END) AS f FROM n GROUP BY sheet),
d AS (SELECT *, CAST(regexp_extract(f, '^(\\d+)', 1) AS DOUBLE) / coalesce(TRY_CAST(nullif(regexp_extract(f, '/(\\d+)"', 1), '') AS DOUBLE), 1) AS drawn, CAST(regexp_extract(f, '=(\\d+)', 1) AS DOUBLE) AS feet FROM g)
SELECT sheet, CASE WHEN drawn > 0 THEN round(feet * 12 / drawn, 4) END AS factor, CASE WHEN n IS NULL THEN 0.0 WHEN n = 1 THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence, coalesce(n, 0) > 1 AS ambiguous, coalesce(all_scales, '') AS all_scales FROM (SELECT DISTINCT sheet FROM t) LEFT JOIN d USING (sheet)"""

_PRIMITIVE = {
    "page": "CAST((event_id - event_id % 24) / 24 AS BIGINT)", "kind": "CASE event_type WHEN 'view' THEN 'line' WHEN 'click' THEN 'rect' ELSE 'curve' END", "x0": "CAST(event_id * 7 % 100 AS DOUBLE)", "y0": "CAST(user_id * 13 % 100 AS DOUBLE)",
    "x1": "CAST(event_id * 7 % 100 + CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id * 17 % 900 END AS DOUBLE)", "y1": "CAST(user_id * 13 % 100 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 29 % 700 END AS DOUBLE)",
}


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "events").select(*(F.expr(e).alias(n) for n, e in _PRIMITIVE.items()))
    return sheets.geometry(p, p.select("page").distinct().withColumn("width", F.lit(1000.0)).withColumn("height", F.lit(800.0)), ["page"])


GEOMETRY_SQL = f"""SELECT page, count(*) FILTER (kind = 'line') AS lines, count(*) FILTER (kind = 'rect') AS rects, count(*) FILTER (kind = 'curve') AS curves, count(*) FILTER (kind = 'line' AND sqrt(w * w + h * h) > 480) AS long_lines,
 count(*) FILTER (kind = 'line' AND least(w, h) < 1) AS axis_lines, bool_or(kind = 'rect' AND w * h > 480000) AS border FROM (SELECT *, abs(x1 - x0) AS w, abs(y1 - y0) AS h FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _PRIMITIVE.items())} FROM events)) GROUP BY page"""


def title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).filter("trim(text) <> ''").select("page", "pos", "text", "x0", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    return sheets.title_blocks(w, ["page"])


TITLES_SQL = f"""WITH w AS (SELECT page, pos, text, x0, y0 AS top, y1 - y0 AS h FROM {_WORDS} WHERE trim(text) <> ''), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY h DESC, pos) AS r FROM w WHERE regexp_full_match(text, '[A-Z]{{1,3}}\\d+(\\.\\d+)*[A-Z]?')) WHERE r = 1),
a AS (SELECT w.*, n.top AS t FROM w JOIN n USING (page) WHERE w.top < n.top AND w.h < n.h AND w.pos <> n.pos), g AS (SELECT *, coalesce(lag(top) OVER (PARTITION BY page ORDER BY top DESC, x0 DESC), t) - top > 60 AS far FROM a),
k AS (SELECT * FROM (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top DESC, x0 DESC ROWS UNBOUNDED PRECEDING) AS cut FROM g) WHERE cut = 0)
SELECT page, n.text AS sheet_number, title FROM n LEFT JOIN (SELECT page, string_agg(text, ' ' ORDER BY round_even(top / 8, 0), x0, text) AS title FROM k GROUP BY page) USING (page)"""

_LIST_WORD = {
    "page": "CAST((o_orderkey - o_orderkey % 60) / 60 AS BIGINT)", "pos": "o_orderkey % 60", "text": "CASE o_orderkey % 4 WHEN 0 THEN chr(CAST(65 + o_custkey % 5 AS INTEGER)) || 'B' WHEN 1 THEN 'WWOORRDD' WHEN 2 THEN 'Anchor' ELSE 'bolt' END",
    "x0": "CAST(CASE CAST((o_orderkey % 60 - o_orderkey % 4) / 4 AS BIGINT) % 3 WHEN 0 THEN 160 WHEN 1 THEN 430 ELSE 715 END + o_orderkey % 4 * 40 AS DOUBLE)", "top": "CAST(CAST((o_orderkey % 60 - o_orderkey % 12) / 12 AS BIGINT) * 20 + o_orderkey % 3 * 2 AS DOUBLE)",
}


def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list in three columns: rows by the first word's height, columns by their anchors, glyphs drawn twice read once."""
    w = _t(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, e in _LIST_WORD.items()))
    return manuals.abbreviations(w, ["page"]).select("page", "abbreviation", "definition")


ABBREVIATIONS_SQL = f"""WITH w AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _LIST_WORD.items())} FROM orders), c AS (SELECT *, CAST(floor(top / 20) AS BIGINT) AS row, CASE WHEN x0 >= 692 THEN 2 WHEN x0 >= 420 THEN 1 WHEN x0 >= 149 THEN 0 END AS col,
 CASE WHEN text = 'WWOORRDD' THEN 'WORD' ELSE text END AS t FROM w), l AS (SELECT page, row, col, list(t ORDER BY x0, pos) AS l FROM c GROUP BY ALL HAVING count(*) >= 2)
SELECT DISTINCT page, l[1] AS abbreviation, array_to_string(l[2:], ' ') AS definition FROM l WHERE regexp_full_match(l[1], '[A-Z0-9/&.\\-]{{1,7}}')"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's words in reading order: bands of height eight, then from left to right."""
    w = sheets.positioned(words(spark, sf_dir))
    key = F.struct(F.bround(F.col("y0") / 8).alias("band"), F.col("x0"), F.col("pos"), F.col("text"))
    return w.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), " ").alias("said"))


READING_SQL = f"SELECT page, string_agg(trim(text), ' ' ORDER BY round_even(y0 / 8, 0), x0, pos) AS said FROM {_WORDS} WHERE trim(text) <> '' GROUP BY page"

# Sheets of every discipline and of none, titles of every drawing type and of none.
_LETTERS = (*X.DISCIPLINES, "Q", "GENERAL")
_TITLES = ("'Level ' || CAST(p_size AS STRING) || ' reflected ceiling plan'", "'Door schedule & elevations'", "p_name", "'ENLARGED FLOOR PLAN'", "'Wall sections and details'", "'  '", "'Demolition, North'", "'First floor plan'", "'South elevation'", "'Stair details'", "'Symbols'", "'List of Abbreviations'")
_NUMBER = f"CASE p_partkey % {len(_LETTERS)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LETTERS)) + " END || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING)"
_TITLE = f"CASE (p_partkey + p_size) % {len(_TITLES)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_TITLES)) + " END"


def drawing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet list: rows with a sheet number and a title, the first of each number, with discipline, type and provisional page."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_NUMBER).alias("sheet_number"), X.strip(F.expr(_TITLE)).alias("sheet_title"))
    good = first_wins(rows.filter(F.col("sheet_number").rlike(X.SHEET_NUMBER) & (F.col("sheet_title") != "")), ["sheet_number"], [F.asc("p_partkey")])
    return good.select("sheet_number", "sheet_title", "p_partkey", X.discipline(F.col("sheet_number")).alias("discipline"), X.drawing_type(F.col("sheet_title")).alias("drawing_type"))


_BY_LETTER = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.DISCIPLINES.items()) + "}"
_BY_WORD = "CASE " + " ".join(f"WHEN contains(upper(sheet_title), '{w}') THEN '{t}'" for w, t in X.DRAWING_TYPES) + " END"
INDEX_SQL = f"""WITH r AS (SELECT p_partkey, {_NUMBER} AS sheet_number, trim({_TITLE}) AS sheet_title FROM part),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_number ORDER BY p_partkey) AS i FROM r WHERE sheet_title <> '' AND regexp_full_match(sheet_number, '[A-Z]{{1,3}}\\d[A-Za-z0-9_.]*')) WHERE i = 1)
SELECT sheet_number, sheet_title, p_partkey, coalesce({_BY_LETTER}[regexp_extract(sheet_number, '^[A-Z]+')], 'Unknown') AS discipline, {_BY_WORD} AS drawing_type FROM g"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names normalised, and each with every letter doubled read as once."""
    name = F.col("c_name")
    doubled = F.regexp_replace(name, "(.)", "$1$1")
    return _t(spark, sf_dir, "customer").select("c_custkey", X.normalize(F.concat(F.lit(" - "), name, F.lit("\n."))).alias("normal"), X.dedouble(doubled).alias("single"), X.dedouble(F.col("c_mktsegment")).alias("segment"))


CLEANED_SQL = "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS normal, c_name AS single, c_mktsegment AS segment FROM customer"

QUERIES = {
    "f22_token_kinds": token_kinds, "f26_positions": positions, "f16_row_keys": row_keys, "f27_area_labels": area_labels, "f28_area_plans": area_plans, "j5_known_rooms": known_rooms, "a3_tag_counts": tag_counts,
    "f23_rotations": rotations, "f25_boxes": point_boxes, "a16_scales": scales, "a15_geometry": geometry, "w17_title_blocks": title_blocks, "w16_abbreviations": abbreviations, "w18_reading_order": reading_order, "r9_drawing_index": drawing_index, "f39_cleaned": cleaned,
}
ORACLE_SQL = {
    "f22_token_kinds": KINDS_SQL, "f26_positions": f"SELECT page, pos, text, x, y FROM {_POSITIONED}", "f16_row_keys": KEYS_SQL, "f27_area_labels": f"SELECT * FROM {_LABELS}", "f28_area_plans": PLANS_SQL, "j5_known_rooms": KNOWN_SQL, "a3_tag_counts": TAGS_SQL,
    "f23_rotations": ROTATIONS_SQL, "f25_boxes": BOXES_SQL, "a16_scales": SCALES_SQL, "a15_geometry": GEOMETRY_SQL, "w17_title_blocks": TITLES_SQL, "w16_abbreviations": ABBREVIATIONS_SQL, "w18_reading_order": READING_SQL, "r9_drawing_index": INDEX_SQL, "f39_cleaned": CLEANED_SQL,
}
