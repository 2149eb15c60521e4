"""Bid packages on the driver's tables: page files, their regions, the artifacts located in them, and hints for parsers.

A hundred documents are a file, two files a package: a manual and a set of drawings.  Marks of contents, schedules and
lists are put on pages, and tables into them, by the number of characters of the document, so that every outcome occurs.
The expressions that make them are the same text for Spark and for SQL; the SQL then follows the rules on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import locator, names, ordered, schema_resolver, sheets
from plumbline.plans.discovery import absorbed_sql
from plumbline.sources.tables import stored, words

_PACKAGE, _FILE, _PAGE = "CAST(floor(doc_id / 200) AS BIGINT)", "CAST(floor(doc_id / 100) AS BIGINT)", "doc_id % 100"
_DRAWN = f"({_FILE} % 2 = 1 OR {_PACKAGE} % 5 = 3)"
# Some pages are of the other size, and files of drawings begin with small pages.
_LARGE = f"CASE WHEN {_PAGE} < 2 AND {_FILE} % 2 = 1 THEN false ELSE {_DRAWN} <> (n_chars % 29 = 0) END"
_LINES = "'TABLE OF CONTENTS' || chr(10) || 'DIVISION 08 - OPENINGS' || chr(10) || '081113 - HOLLOW METAL DOORS'"
_EXTRA = f"""CASE
 WHEN NOT {_DRAWN} AND {_PAGE} BETWEEN 3 AND 9 AND {_PACKAGE} % 4 <> 1 THEN {_LINES} || CASE WHEN n_chars % 4 <> 0 THEN chr(10) || '096813 - TILE CARPETING' ELSE '' END
 WHEN NOT {_DRAWN} AND {_PAGE} IN (40, 60) THEN 'TABLE OF CONTENTS'
 WHEN {_DRAWN} AND {_PAGE} IN (2, 3) THEN 'SHEET NUMBER SHEET NAME'
 WHEN {_DRAWN} AND {_PAGE} IN (6, 70) THEN 'ABBREVIATION ' || repeat('ABC ', CAST(n_chars % 1000 AS INTEGER))
 WHEN {_DRAWN} AND {_PAGE} BETWEEN 20 AND 29 THEN 'DOOR SCHEDULE' || CASE WHEN n_chars % 11 = 0 THEN '' ELSE ' FIRE RATING' END
 WHEN {_DRAWN} AND {_PAGE} BETWEEN 30 AND 33 THEN 'ROOM FINISH SCHEDULE'
 ELSE '' END"""
_BODY = f"text || chr(10) || {_EXTRA}"

_DOORS, _FINISHES = f"{_DRAWN} AND {_PAGE} BETWEEN 20 AND 29", f"{_DRAWN} AND {_PAGE} BETWEEN 30 AND 33"
#: Rows of the tables of pages: condition, table, row, cells.
_ROWS = [
    (f"{_DRAWN} AND {_PAGE} IN (2, 3) AND n_chars % 3 <> 0", 0, 0, ("SHEET NUMBER", "SHEET NAME")),
    (f"{_DRAWN} AND {_PAGE} IN (2, 3) AND n_chars % 3 = 0", 0, 0, ("NO.", "NAME")),
    (f"{_DRAWN} AND {_PAGE} IN (2, 3)", 0, 1, ("A1.1", "FLOOR PLAN")),
    (_DOORS, 0, 0, ("MARK", "WIDTH", "HEIGHT", "DOOR MATERIAL", "NOTES")),
    (_DOORS, 1, 0, ("DOOR SCHEDULE", "", "", "", "", "")),
    (f"{_DOORS} AND n_chars % 3 = 0", 1, 1, ("MARK", "Width", "HEIGHT", "Door\nMaterial", "HARDWARE SET", "COLOUR")),
    (f"{_DOORS} AND n_chars % 3 = 1", 1, 1, ("Door No.", "WIDTH", "HEIGHT", "COLOUR", "HARDWARE SET", "GLASS TYPE")),
    (f"{_DOORS} AND n_chars % 3 = 2", 1, 1, ("MARK", "WIDTH", "COLOUR", "HARDWARE SET", "GLASS TYPE", "LOCATION")),
    (_DOORS, 1, 2, ("N101A", "3'-0\"", "7'-0\"", "WD", "HW-1", "")),
    (f"{_FINISHES} AND n_chars % 4 = 3", 0, 0, ("WALL TYPES", "CEILING", "", "", "", "", "")),
    (f"{_FINISHES} AND n_chars % 4 = 1", 0, 1, ("NUMBER", "NAME", "FLOOR", "BASE", "WALL", "CEILING", "NOTES")),
    (f"{_FINISHES} AND n_chars % 4 <> 3", 0, 0, ("FINISHES", "", "", "", "", "", "")),
    (f"{_FINISHES} AND n_chars % 2 = 0", 1, 0, ("ROOM  FINISH\nSCHEDULE", "", "", "", "", "", "")),
    (f"{_FINISHES} AND n_chars % 5 = 0", 2, 0, ("ROOM FINISH SCHEDULE", "", "", "", "", "", "")),
]


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_PACKAGE} AS package", f"{_FILE} AS file_id", f"{_PAGE} AS page_index", *columns)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package, file_id, page_index, large, anchor_hits, short_token_count of every page."""
    made = _docs(spark, sf_dir, f"{_BODY} AS body", f"{_LARGE} AS large")
    return made.select(*locator.PAGE, "large", X.anchor_hits(F.col("body")).alias("anchor_hits"), X.short_tokens(F.col("body")).alias("short_token_count"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, f"{_BODY} AS text")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package, file_id, page_index, table_ord, row_ord, col_ord, text of all tables of all pages."""
    rows = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(t).alias("table_ord"), F.lit(r).alias("row_ord"), F.array(*map(F.lit, x)).alias("x"))) for c, t, r, x in _ROWS)))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(_PACKAGE).alias("package"), F.expr(_FILE).alias("file_id"), F.expr(_PAGE).alias("page_index"), F.explode(rows).alias("_r"))
    return made.select(*locator.PAGE, "_r.table_ord", "_r.row_ord", F.posexplode("_r.x").alias("col_ord", "text"))


def regions(of: DataFrame) -> DataFrame:
    """package, file_id, kind, page_start, page_end, pages: absorbed runs of sizes, short ends without anchors as front matter."""
    kinds = of.select(*locator.PAGE, F.when(F.col("large"), "drawings").otherwise("manual").alias("kind"))
    return locator.front_matter(ordered.regions(kinds, ["package", "file_id"], "page_index", "kind", 3), of)


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(stored(profiles(spark, sf_dir), "profiles"))


_HITS = ", ".join(f"CASE WHEN contains(upper(body), '{a}') THEN '{a}' END" for a in X.ANCHORS)
_BASE_SQL = f"""WITH RECURSIVE page AS (SELECT {_PACKAGE} AS package, {_FILE} AS file_id, {_PAGE} AS page_index, {_BODY} AS body, CASE WHEN {_LARGE} THEN 'd' ELSE 'm' END AS kind, n_chars, doc_id FROM documents),
hit AS (SELECT *, list_filter([{_HITS}], lambda a: a IS NOT NULL) AS hits FROM page), {absorbed_sql('page')},
ends AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_start) AS a, row_number() OVER (PARTITION BY file_id ORDER BY page_start DESC) AS z FROM region),
kept AS (SELECT DISTINCT e.file_id, e.page_start FROM ends e JOIN hit h ON h.file_id = e.file_id AND h.page_index BETWEEN e.page_start AND e.page_end WHERE list_has_any(hits, {list(locator.MANUAL_ANCHORS)})),
marked AS (SELECT CAST(floor(e.file_id / 2) AS BIGINT) AS package, e.file_id, CASE WHEN (a = 1 OR z = 1) AND kind = 'manual' AND pages < 3 AND k.file_id IS NULL THEN 'front_matter' ELSE kind END AS kind, e.page_start, page_end, pages
 FROM ends e LEFT JOIN kept k ON k.file_id = e.file_id AND k.page_start = e.page_start)"""
FRONT_SQL = f"{_BASE_SQL} SELECT package, file_id, kind, page_start, page_end, pages FROM marked"


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = stored(profiles(spark, sf_dir), "profiles")
    where = stored(regions(of), "regions")
    return locator.locate(of.select("package").distinct(), of, where, texts(spark, sf_dir), cells(spark, sf_dir))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact of every package: status, confidence, and its pages as file:page."""
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["file_id"].cast("string"), p["page_index"].cast("string"))), " ")
    return _located(spark, sf_dir).select("package", "artifact", "status", "confidence", F.coalesce(pages, F.lit("")).alias("pages"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CELLS = " UNION ALL ".join(f"SELECT doc_id, {t} AS t, {r} AS r, {j} AS c, {_literal(x)} AS text FROM documents WHERE {cond}" for cond, t, r, xs in _ROWS for j, x in enumerate(xs))
_CORE = ", ".join(f"('{s}', '{f}')" for f in schema_resolver.DOOR.core for s in schema_resolver.DOOR.synonyms[f])
_SPEC_ROWS = ", ".join(f"('{s.name}', '{s.region}', {list(s.anchors)}, {str(s.every).lower()}, {str(s.run).lower()}, {s.least})" for s in locator.SPECS)
_LOCATED_SQL = f"""{_BASE_SQL},
spec AS (SELECT * FROM (VALUES {_SPEC_ROWS}) v(artifact, region, anchors, every, run, least)),
asked AS (SELECT h.*, s.artifact, s.run FROM hit h JOIN spec s ON CASE WHEN every THEN list_has_all(hits, anchors) ELSE list_has_any(hits, anchors) END
 WHERE EXISTS (SELECT 1 FROM marked m WHERE m.file_id = h.file_id AND m.kind = s.region AND h.page_index BETWEEN m.page_start AND m.page_end)),
cell AS ({_CELLS}),
shape AS (SELECT doc_id, t, max(c) FILTER (r = 0) + 1 AS width, bool_or(c = 0 AND contains(text, 'SHEET') AND contains(text, 'NUMBER')) AS listed,
 upper(string_agg(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), ' ' ORDER BY r, c) FILTER (r < 3)) AS header FROM cell GROUP BY 1, 2),
core AS (SELECT c.doc_id, c.t, count(DISTINCT field) / 4 AS coverage FROM cell c JOIN (VALUES {_CORE}) v(label, field) ON trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) = label WHERE r = 1 GROUP BY 1, 2),
score AS (SELECT a.*, CASE artifact
 WHEN 'spec_toc' THEN CASE WHEN len(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '^\\s*DIVISION\\s+\\d{{2}}\\s*-\\s*.') OR regexp_matches(l, '^\\s*(SECTION\\s+)?\\d{{2}}\\s?\\d{{2}}\\s?\\d{{2}}(\\.\\d{{2}})?\\s*-?\\s*.'))) >= 3 THEN 1.0 END
 WHEN 'drawing_index' THEN (SELECT max(1.0) FROM shape s WHERE s.doc_id = a.doc_id AND listed)
 WHEN 'door_schedule' THEN (SELECT max(coverage) FROM shape s JOIN core c ON c.doc_id = s.doc_id AND c.t = s.t WHERE s.doc_id = a.doc_id AND width >= 6 AND coverage >= 0.75)
 WHEN 'finish_schedule' THEN (SELECT arg_min(CASE WHEN contains(header, 'ROOM FINISH SCHEDULE') THEN 1.0 ELSE 0.7 END, t) FROM shape s WHERE s.doc_id = a.doc_id AND width = 7
  AND (contains(header, 'ROOM FINISH SCHEDULE') OR (contains(header, 'FLOOR') AND contains(header, 'BASE') AND contains(header, 'WALL') AND contains(header, 'CEILING'))))
 ELSE round(n_short / (n_short + 400.0), 3) END::DOUBLE AS confidence FROM (SELECT *, len(list_filter(string_split_regex(body, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{1,4}}'))) AS n_short FROM asked) a),
sure AS (SELECT * FROM score WHERE confidence > 0),
island AS (SELECT *, page_index - row_number() OVER (PARTITION BY artifact, file_id ORDER BY page_index) AS i FROM sure WHERE run),
best_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package, artifact ORDER BY n DESC, weight DESC, file_id, first) AS k FROM
 (SELECT package, artifact, file_id, i, count(*) AS n, round(sum(confidence), 6) AS weight, min(page_index) AS first FROM island GROUP BY 1, 2, 3, 4)) WHERE k = 1),
picked AS (SELECT x.package, x.artifact, x.file_id, x.page_index, x.confidence FROM island x JOIN best_run b ON b.package = x.package AND b.artifact = x.artifact AND b.file_id = x.file_id AND b.i = x.i
 UNION ALL SELECT package, artifact, file_id, page_index, confidence FROM (SELECT *, row_number() OVER (PARTITION BY package, artifact ORDER BY confidence DESC, file_id, page_index) AS k FROM sure WHERE NOT run) WHERE k = 1),
placed AS (SELECT package, artifact, max(confidence) AS confidence, list(struct_pack(f := file_id, p := page_index) ORDER BY file_id, page_index) AS pages FROM picked GROUP BY 1, 2),
answer AS (SELECT k.package, s.artifact, CASE WHEN NOT EXISTS (SELECT 1 FROM marked m WHERE m.package = k.package AND m.kind = s.region) THEN 'not_applicable' WHEN confidence IS NULL THEN 'absent'
 WHEN confidence >= least THEN 'found' ELSE 'low_confidence' END AS status, confidence, pages FROM (SELECT DISTINCT package FROM page) k CROSS JOIN spec s LEFT JOIN placed p ON p.package = k.package AND p.artifact = s.artifact)"""
LOCATED_SQL = f"{_LOCATED_SQL} SELECT package, artifact, status, confidence, coalesce(array_to_string(list_transform(pages, lambda x: x.f || ':' || x.p), ' '), '') AS pages FROM answer"


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locator.page_hints(_located(spark, sf_dir))


_FIRST = ", ".join(f"max(pages[1].p) FILTER (artifact = '{n}') AS {n}" for n in ("drawing_index", "door_schedule", "finish_schedule", "abbreviations"))
HINTS_SQL = f"{_LOCATED_SQL} SELECT package, max(pages[1].p) FILTER (artifact = 'spec_toc') AS toc_start, coalesce(max(pages[-1].p + 1) FILTER (artifact = 'spec_toc'), 0) AS section_start_hint, {_FIRST} FROM answer GROUP BY package"


def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every word of benchmark texts the closest word of conversations; no SQL, as the ratio of matching blocks is recursive."""
    said = lambda t: words(spark.read.parquet(f"{sf_dir}/{t}.parquet").select("text"), []).select(F.lower("word").alias("name"))
    return names.closest(said("benchmark"), said("conversations"))


def text_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of nested pages: a conversation is a page, a turn a block, with lines of words; system turns are images."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = lambda x: F.struct(F.when(F.length(x) % 2 == 0, 0.0).alias("dx"), F.lit(1.0).alias("dy"), F.transform(F.split(x, " "), lambda w: F.struct(w.alias("text"))).alias("spans"))
    block = F.struct("turn", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 0).alias("type"), F.transform(F.split("text", "\n"), line).alias("lines"))
    pages = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return sheets.text_objects(pages, ["conv_id"]).groupBy("conv_id", "block", "line", "rotation").agg(F.count("*").alias("spans"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), " ").alias("text"))


OBJECTS_SQL = """WITH b AS (SELECT conv_id, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS block FROM conversations),
l AS (SELECT conv_id, block, lines[i] AS t, CAST(i - 1 AS INTEGER) AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM b WHERE role <> 'system'))),
w AS (SELECT conv_id, block, line, t, unnest(string_split(t, ' ')) AS word, unnest(range(len(string_split(t, ' ')))) AS i FROM l)
SELECT conv_id, block, line, CASE WHEN length(t) % 2 = 0 THEN 90 ELSE 0 END AS rotation, count(*) AS spans, string_agg(trim(word), ' ' ORDER BY i) AS text FROM w WHERE trim(word) <> '' GROUP BY conv_id, block, line, t"""


def known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and artifacts of all packages with a flag for those that are not known by name; unknown ones stay."""
    of = stored(profiles(spark, sf_dir), "profiles")
    kinds = regions(of).select("package", "file_id", F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("new_"), "kind")).otherwise(F.col("kind")).alias("kind"))
    return kinds.groupBy("kind", F.col("kind").isin(*locator.KNOWN_REGIONS).alias("known")).agg(F.count("*").alias("regions"))


KNOWN_SQL = f"{_BASE_SQL}, k AS (SELECT CASE WHEN file_id % 7 = 0 THEN 'new_' || kind ELSE kind END AS kind FROM marked) SELECT kind, kind IN {locator.KNOWN_REGIONS} AS known, count(*) AS regions FROM k GROUP BY 1, 2"

QUERIES = {"f24_text_objects": text_objects, "f40_known": known_values, "w7_locate_all": located, "w4_front_matter": front_matter, "r13_page_hints": hints, "r19_closest_names": closest_names}
ORACLE_SQL = {"f24_text_objects": OBJECTS_SQL, "f40_known": KNOWN_SQL, "w7_locate_all": LOCATED_SQL, "w4_front_matter": FRONT_SQL, "r13_page_hints": HINTS_SQL}
