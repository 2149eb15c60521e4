"""Project manuals on the driver's tables: contents, sections, clauses, bid items, finish lists and code meanings.

Lines of contents are made from ``part`` (a file is 200 keys, a page 20), lines of sections and bid documents from
``orders``.  The expressions that make them are the same text for Spark and for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.operators import joins, manuals
from plumbline.operators.ordered import first_wins


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOC = {
    "file": "CAST((p_partkey - p_partkey % 200) / 200 AS BIGINT)", "page": "CAST((p_partkey % 200 - p_partkey % 20) / 20 AS BIGINT)", "line_ord": "p_partkey % 20",
    "line": "CASE WHEN p_partkey % 200 >= 160 THEN 'Plain page ' || p_name WHEN p_partkey % 20 = 0 THEN 'DIVISION ' || lpad(CAST(p_partkey % 200 / 20 * 4 AS STRING), 2, '0') || ' – ' || upper(p_type) "
    "WHEN p_partkey % 20 = 1 THEN 'BID SET' WHEN p_partkey % 20 = 5 THEN 'and ' || p_name WHEN p_partkey % 20 = 9 THEN '  ' WHEN p_partkey % 20 = 13 THEN '12 March 2024' WHEN p_partkey % 40 = 34 THEN 'NOT APPLICABLE' "
    "WHEN p_partkey % 3 = 0 THEN 'SECTION 08' || CAST(1000 + p_partkey % 9000 AS STRING) || ' - ' || p_name WHEN p_partkey % 3 = 1 THEN '08 ' || CAST(10 + p_partkey % 90 AS STRING) || ' 13 ' || p_name || '-' ELSE '07' || CAST(1000 + p_partkey % 9000 AS STRING) || '.13 ' || p_name END",
}
_TOC["line"] = _TOC["line"].replace("CAST(p_partkey % 200 / 20 * 4 AS STRING)", "CAST(CAST((p_partkey % 200 - p_partkey % 20) / 5 AS BIGINT) AS STRING)")
_LINES = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _TOC.items()) + " FROM part)"
def _division(group: int) -> str:
    return "regexp_extract(line, '^\\s*DIVISION\\s+(\\d{2})\\s*[-‒–—―−]\\s*(.+?)\\s*$', " + f"{group})"



def _section(group: int) -> str:
    return "regexp_extract(line, '^\\s*(?:SECTION\\s+)?(\\d{2}\\s?\\d{2}\\s?\\d{2}(?:\\.\\d{2})?)\\s*[-‒–—―−]?\\s*(.+?)\\s*$', " + f"{group})"



def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(*(F.expr(e).alias(n) for n, e in _TOC.items()))


def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of contents of each file, with how many lines of the contents' grammar each has and whether that confirms it (three)."""
    lines = toc_lines(spark, sf_dir)
    fits = F.col("line").rlike(manuals.DIVISION) | F.col("line").rlike(manuals.SECTION)
    pages = lines.groupBy("file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count_if(fits).alias("hits"))
    return manuals.toc_pages(pages, ["file"], "page").select("file", "page", "hits", (F.col("hits") >= 3).alias("confirmed"))


TOC_PAGES_SQL = f"""WITH p AS (SELECT file, page, bool_or({_division(1)} <> '') AS toc, count(*) FILTER ({_division(1)} <> '' OR {_section(1)} <> '') AS hits FROM {_LINES} GROUP BY 1, 2), f AS (SELECT *, min(CASE WHEN toc THEN page END) OVER (PARTITION BY file) AS first FROM p),
g AS (SELECT *, min(CASE WHEN NOT toc AND page > first THEN page END) OVER (PARTITION BY file) AS gap FROM f) SELECT file, page, hits, hits >= 3 AS confirmed FROM g WHERE page >= first AND (gap IS NULL OR page < gap)"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the pages that are found to be contents."""
    return toc_lines(spark, sf_dir).join(toc_pages(spark, sf_dir).filter("confirmed").select("file", "page"), ["file", "page"], "left_semi")


def toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections = manuals.toc(_contents(spark, sf_dir), ["file"], ["page", "line_ord"])
    return sections


_CARRIED = f"""n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page, line_ord) AS ord, nullif({_division(1)}, '') AS div, nullif({_division(2)}, '') AS div_title, upper(trim(line)) = 'NOT APPLICABLE' AS na FROM {_LINES} l WHERE EXISTS (SELECT 1 FROM ({TOC_PAGES_SQL}) t WHERE confirmed AND t.file = l.file AND t.page = l.page) AND trim(line) NOT IN ('', 'BID SET') AND NOT regexp_matches(trim(line), '^\\d{{1,2}}\\s+[A-Za-z]+\\s+\\d{{4}}$')),
c AS (SELECT *, last_value(CASE WHEN div IS NOT NULL THEN ord END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ord ROWS UNBOUNDED PRECEDING) AS d_ord, last_value(div IGNORE NULLS) OVER (PARTITION BY file ORDER BY ord ROWS UNBOUNDED PRECEDING) AS division,
 CASE WHEN div IS NULL AND NOT na THEN nullif(replace({_section(1)}, ' ', ''), '') END AS num FROM n)"""
SECTIONS_SQL = f"""WITH {_CARRIED}, s AS (SELECT *, last_value(CASE WHEN num IS NOT NULL THEN ord END IGNORE NULLS) OVER (PARTITION BY file, d_ord ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s_ord FROM c WHERE d_ord IS NOT NULL),
p AS (SELECT file, division, s_ord, num, ord, CASE WHEN num IS NOT NULL THEN {_section(2)} WHEN div IS NULL AND NOT na AND division <> '00' THEN trim(line) END AS piece FROM s WHERE s_ord IS NOT NULL)
SELECT file, CAST(s_ord AS INTEGER) AS ord, division, max(num) AS section, trim(replace(string_agg(piece, ' ' ORDER BY ord), '- ', '-')) AS title FROM p WHERE piece IS NOT NULL GROUP BY file, division, s_ord"""


def toc_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    divisions, _ = manuals.toc(_contents(spark, sf_dir), ["file"], ["page", "line_ord"])
    return divisions


DIVISIONS_SQL = f"WITH {_CARRIED} SELECT file, CAST(d_ord AS INTEGER) AS ord, max(div) AS division, max(div_title) AS title, NOT bool_or(na) AS applicable FROM c WHERE d_ord IS NOT NULL GROUP BY file, d_ord"

_BODY = {
    "file": "CAST((o_orderkey - o_orderkey % 200) / 200 AS BIGINT)", "page": "CAST((o_orderkey % 200 - o_orderkey % 10) / 10 AS BIGINT)", "line_ord": "o_orderkey % 10",
    "line": "CASE WHEN o_orderkey % 70 = 0 THEN 'SECTION 08' || CAST(1000 + o_orderkey % 200 AS STRING) || ' - DOORS AND FRAMES' WHEN o_orderkey % 70 = 45 THEN 'END OF SECTION' WHEN o_orderkey % 20 = 1 THEN 'PART ' || CAST(1 + o_orderkey % 3 AS STRING) || ' - GENERAL' "
    "WHEN o_orderkey % 5 = 2 THEN CAST(1 + o_custkey % 3 AS STRING) || '.' || lpad(CAST(o_custkey % 12 AS STRING), 2, '0') || ' SUBMITTALS' WHEN o_orderkey % 5 = 3 THEN 'Comply with ASTM E' || CAST(o_custkey % 90 + 100 AS STRING) || ' and NFPA ' || CAST(o_custkey % 50 + 10 AS STRING) || '.' ELSE 'Text of line ' || CAST(o_custkey AS STRING) END",
}
_BODIES = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BODY.items()) + " FROM orders)"


def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, e in _BODY.items()))


def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each section by its head, the first eight lines with text."""
    pages = body_lines(spark, sf_dir).groupBy("file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return manuals.section_starts(pages, ["file"], "page")


STARTS_SQL = f"SELECT file, regexp_extract(line, 'SECTION (\\d{{6}})', 1) AS section, min(page) AS page FROM {_BODIES} WHERE line_ord < 8 AND regexp_matches(line, 'SECTION \\d{{6}}') GROUP BY 1, 2"


def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's first and last page: to the page with the closing words, or before the next section's page; at most 60."""
    return manuals.section_bounds(body_lines(spark, sf_dir), ["file"])


BOUNDS_SQL = f"""WITH l AS (SELECT file, page, bool_or(contains(line, 'END OF SECTION')) AS ends, bool_or(regexp_matches(line, '^\\s*SECTION\\s+\\d{{6}}')) AS head FROM {_BODIES} GROUP BY 1, 2),
s AS (SELECT file, regexp_extract(line, '^\\s*SECTION\\s+(\\d{{6}})', 1) AS section, min(page) AS start FROM {_BODIES} WHERE regexp_matches(line, '^\\s*SECTION\\s+\\d{{6}}\\s*[-‒–—―−]') GROUP BY 1, 2),
m AS (SELECT s.file, section, start, min(CASE WHEN ends THEN page WHEN head AND page > start THEN page - 1 END) AS stop, max(page) AS last FROM s JOIN l ON s.file = l.file AND page >= start AND page < start + 60 GROUP BY ALL)
SELECT file, section, start, coalesce(stop, last) AS stop FROM m"""


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the parts of a file: a clause's major number is its part's, its body reaches to the next one."""
    return manuals.clauses(body_lines(spark, sf_dir), ["file"], ["page", "line_ord"]).select("file", "part", "clause", "title", "ord", "n_lines", F.array_join("standards", ",").alias("standards"))


CLAUSES_SQL = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page, line_ord) AS ord, TRY_CAST(nullif(regexp_extract(line, '^\\s*PART\\s+([1-3])\\s*[-‒–—―−]\\s*(.+?)\\s*$', 1), '') AS INTEGER) AS p FROM {_BODIES}),
q AS (SELECT *, last_value(p IGNORE NULLS) OVER w AS part, last_value(CASE WHEN p IS NOT NULL THEN ord END IGNORE NULLS) OVER w AS p_ord, nullif(regexp_extract(line, '^\\s*(\\d\\.\\d{{2}})\\s+(.+?)\\s*$', 1), '') AS cid, regexp_extract(line, '^\\s*(\\d\\.\\d{{2}})\\s+(.+?)\\s*$', 2) AS ct FROM n WINDOW w AS (PARTITION BY file ORDER BY ord ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, last_value(CASE WHEN p IS NULL AND cid IS NOT NULL AND substr(cid, 1, 1) = CAST(part AS VARCHAR) THEN ord END IGNORE NULLS) OVER (PARTITION BY file, p_ord ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c_ord FROM q WHERE part IS NOT NULL),
g AS (SELECT file, part, c_ord, max(CASE WHEN ord = c_ord THEN cid END) AS clause, max(CASE WHEN ord = c_ord THEN ct END) AS title, count(*) - 1 AS n_lines, string_agg(line, ' ' ORDER BY ord) AS body FROM c WHERE c_ord IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT file, c_ord, unnest(regexp_extract_all(body, '(?:ASTM|NFPA|ANSI|UL)\\s+[A-Z]?\\d+')) AS std, unnest(range(1, len(regexp_extract_all(body, '(?:ASTM|NFPA|ANSI|UL)\\s+[A-Z]?\\d+')) + 1)) AS i FROM g), d AS (SELECT file, c_ord, std, min(i) AS i FROM s GROUP BY ALL)
SELECT file, part, clause, title, CAST(c_ord AS INTEGER) AS ord, n_lines, coalesce((SELECT string_agg(std, ',' ORDER BY i) FROM d WHERE d.file = g.file AND d.c_ord = g.c_ord), '') AS standards FROM g"""

_BID = (
    "'Bid of ' || c_name || chr(10) || 'Alternate No. ' || CAST(c_custkey % 9 + 1 AS STRING) || ': Canopy ' || c_mktsegment || '.' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'A Deductive Alternate applies' WHEN 1 THEN 'Additive alternate' ELSE 'as shown' END || chr(10) "
    "|| 'Base Bid: plain  entry' || chr(10) || 'alternate no 12: Roof' || chr(10) || 'Add Alternate' || chr(10) || 'Unit Price No. 3: Rock' || chr(10) || 'Description: removal of rock' || chr(10) || 'Unit of Measurement: cubic yard.' || chr(10)"
)
_BID = _BID.replace("chr(10)", "'\n'")


def bid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_BID).alias("text"))
    parts = [manuals.bid_items(docs, k, ["c_custkey"]).withColumn("kind", F.lit(k)) for k in ("alternate", "unit_price")]
    return parts[0].unionByName(parts[1]).select("c_custkey", "kind", F.col("ordinal").cast("int").alias("ordinal"), "number", "title", "basis", "description", "unit")


BID_SQL = """SELECT c_custkey, 'alternate' AS kind, 0 AS ordinal, CAST(c_custkey % 9 + 1 AS VARCHAR) AS number, 'Canopy ' || c_mktsegment AS title, CASE c_custkey % 3 WHEN 0 THEN 'deduct' WHEN 1 THEN 'add' ELSE 'unknown' END AS basis, 'plain entry' AS description, NULL::VARCHAR AS unit FROM customer
 UNION ALL SELECT c_custkey, 'alternate', 1, '12', 'Roof', 'add', '', NULL FROM customer UNION ALL SELECT c_custkey, 'unit_price', 0, '3', 'Rock', 'unit', 'removal of rock', 'cubic yard' FROM customer"""


def bid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by kind and basis over all bids, and in how many bids each is."""
    return bid_items(spark, sf_dir).groupBy("kind", "basis").agg(F.count("*").alias("items"), F.countDistinct("c_custkey").alias("bids"))


_FINISH = "'P-' || CAST(s_suppkey % 5 AS STRING) || ' TYPE: GENERAL PAINT ' || s_name || ' COLOR: WHITE CPT-' || CAST(s_suppkey AS STRING) || 'A TYPE: CARPET TILE STYLE: MATTE P-' || CAST(s_suppkey % 5 AS STRING) || ' TYPE: AGAIN'"


def finish_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each list with the text to the next code, the first of each code, and its TYPE up to the next field."""
    return manuals.finish_codes(_t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_FINISH).alias("text")), ["s_suppkey"]).select("s_suppkey", "code", "definition", "described")


FINISH_SQL = """SELECT s_suppkey, 'P-' || s_suppkey % 5 AS code, 'P-' || s_suppkey % 5 || ' TYPE: GENERAL PAINT ' || s_name || ' COLOR: WHITE' AS definition, 'GENERAL PAINT ' || s_name AS described FROM supplier
 UNION ALL SELECT s_suppkey, 'CPT-' || s_suppkey || 'A', 'CPT-' || s_suppkey || 'A TYPE: CARPET TILE STYLE: MATTE', 'CARPET TILE' FROM supplier"""

_CODE = "CASE p_partkey % 6 WHEN 0 THEN 'WD-' || CAST(p_size AS STRING) WHEN 1 THEN 'HM' WHEN 2 THEN 'CPT-' || CAST(p_size % 3 AS STRING) WHEN 3 THEN 'P-1' WHEN 4 THEN '(E)' ELSE 'XX' || CAST(p_size AS STRING) END"


def expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaning of each part's code: as a material the abbreviation first, as a finish the shortest finish of its letters."""
    codes = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    abbrev = _t(spark, sf_dir, "nation").select(F.expr("CASE n_nationkey WHEN 0 THEN 'WD' WHEN 1 THEN 'HM' WHEN 2 THEN 'WD-7' ELSE 'N' || CAST(n_nationkey AS STRING) END").alias("code"), F.col("n_name").alias("definition"))
    finish = manuals.finish_codes(_t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_FINISH).alias("text")), ["s_suppkey"]).select("code", "described", F.col("s_suppkey").alias("ord"))
    return manuals.expansions(codes, abbrev, finish)


EXPANSIONS_SQL = f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), a AS (SELECT CASE n_nationkey WHEN 0 THEN 'WD' WHEN 1 THEN 'HM' WHEN 2 THEN 'WD-7' ELSE 'N' || n_nationkey END AS code, n_name AS d FROM nation),
f AS (SELECT prefix, arg_min(d, length(d) * 1000000000 + s_suppkey) AS d FROM (SELECT 'P' AS prefix, 'GENERAL PAINT ' || s_name AS d, s_suppkey FROM supplier UNION ALL SELECT 'CPT', 'CARPET TILE', s_suppkey FROM supplier) GROUP BY prefix),
j AS (SELECT p_partkey, c.code, coalesce(a.d, b.d) AS material, f.d AS finish FROM c LEFT JOIN a ON a.code = c.code LEFT JOIN a b ON b.code = upper(regexp_extract(c.code, '^[A-Za-z]+')) LEFT JOIN f ON f.prefix = upper(regexp_extract(c.code, '^[A-Za-z]+')))
SELECT p_partkey, code, coalesce(material, finish, '') AS as_material, coalesce(finish, material, '') AS as_finish FROM j"""


def part_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored match: every part's name and type against the names of all parts as titles, by shared beginnings of words."""
    toks = lambda c: F.filter(F.split(X.normalize(c), " "), lambda w: F.length(w) > 1)
    q = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), toks(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    t = _t(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("title_id")).select("title_id", toks(F.concat(F.lit("the "), F.col("p_name"), F.lit("s"))).alias("tokens"))
    return joins.best_title(q, t, 0.5)


_TOKS = "[x FOR x IN string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ') IF length(x) > 1]".format
PART_SECTIONS_SQL = f"""WITH q AS (SELECT p_partkey AS query_id, {_TOKS("p_name || ' ' || p_type")} AS q FROM part), t AS (SELECT title_id, {_TOKS("'the ' || p_name || 's'")} AS t FROM (SELECT p_name, min(p_partkey) AS title_id FROM part GROUP BY p_name)), d AS (SELECT DISTINCT q FROM q),
s AS (SELECT q, title_id, len([a FOR a IN q IF len([b FOR b IN t IF a = b OR (least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)))]) > 0]) / len(q) AS score FROM d, t),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, title_id) AS r FROM s WHERE score > 0.5) WHERE r = 1) SELECT query_id, title_id, score FROM q JOIN b USING (q)"""


def signature_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of their language's signature, with any, and the score of short capitals."""
    sig = F.when(F.col("lang") == "en", F.array(F.lit("the"), F.lit("and"))).when(F.col("lang") == "de", F.array(F.lit("der"), F.lit("ich"))).otherwise(F.array().cast("array<string>"))
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", sig.alias("sig"))
    some = F.exists("sig", lambda x: F.contains(F.lower("text"), x))
    return d.select("doc_id", X.has_all(F.col("text"), F.col("sig")).alias("all_words"), some.alias("any_word"), F.round(X.abbreviation_score(X.short_tokens(F.col("text"))), 9).alias("score"))


SIGNATURE_SQL = """WITH d AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN ['the', 'and'] WHEN 'de' THEN ['der', 'ich'] ELSE [] END AS sig FROM documents)
SELECT doc_id, len(sig) > 0 AND len([x FOR x IN sig IF NOT contains(lower(text), x)]) = 0 AS all_words, len([x FOR x IN sig IF contains(lower(text), x)]) > 0 AS any_word,
 round(c / (c + 400.0::DOUBLE), 9) AS score FROM (SELECT *, len([w FOR w IN string_split_regex(text, '[^\\p{L}\\p{N}_]+') IF regexp_full_match(w, '[A-Z]{1,4}')]) AS c FROM d)"""

QUERIES = {
    "f11_toc_pages": toc_pages, "w9_toc_sections": toc_sections, "w9_toc_divisions": toc_divisions, "w13_section_starts": section_starts, "w11_section_bounds": section_bounds, "w10_clauses": clauses, "r10_bid_items": bid_items, "a8_bid_summary": bid_summary,
    "r8_finish_list": finish_list, "j14_expansions": expansions, "r12_part_sections": part_sections, "f7_signatures": signature_pages,
}
ORACLE_SQL = {
    "f11_toc_pages": TOC_PAGES_SQL, "w9_toc_sections": SECTIONS_SQL, "w9_toc_divisions": DIVISIONS_SQL, "w13_section_starts": STARTS_SQL, "w11_section_bounds": BOUNDS_SQL, "w10_clauses": CLAUSES_SQL, "r10_bid_items": BID_SQL,
    "a8_bid_summary": f"SELECT kind, basis, count(*) AS items, count(DISTINCT c_custkey) AS bids FROM ({BID_SQL}) GROUP BY 1, 2", "r8_finish_list": FINISH_SQL, "j14_expansions": EXPANSIONS_SQL, "r12_part_sections": PART_SECTIONS_SQL, "f7_signatures": SIGNATURE_SQL,
}
