"""Sections on the driver's tables: codes and their sections, texts of sections, products, standards and clauses.

Parts are codes and titles, orders the lines of manuals, customers clauses on manufacturers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import manuals, sections
from plumbline.plans import manuals_book as M

_SECTION = "lpad(CAST(p_partkey % 1000000 AS STRING), 6, '0')"
DIVISION = "0000"


def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for every part's code: derived from the titles of one division, or the seed's where they differ."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    codes = part.select(F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("expansion"))
    titles = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).selectExpr(f"{_SECTION} AS section", "'Work of the ' || p_name || 's' AS title")
    seed = part.filter("p_partkey % 4 = 0").selectExpr("p_partkey AS code", "lpad(CAST(p_partkey % 60 AS STRING), 6, '0') AS section")
    return sections.section_map(codes, titles, seed, DIVISION)


_TOKS = f"[x FOR x IN string_split(trim(regexp_replace(lower({{}}), '[^a-z0-9]+', ' ', 'g')), ' ') IF length(x) > 1 AND NOT list_contains({list(sections.STOP)}, x)]".format
MAP_SQL = f"""WITH q AS (SELECT p_partkey AS code, {_TOKS("CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || ' ' || p_type END")} AS q FROM part),
t AS (SELECT * FROM (SELECT {_SECTION} AS section, {_TOKS("'Work of the ' || p_name || 's'")} AS t FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1)) WHERE starts_with(section, '{DIVISION}')),
s AS (SELECT q, section, len([a FOR a IN q IF len([b FOR b IN t IF a = b OR (least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)))]) > 0]) / len(q) AS score FROM (SELECT DISTINCT q FROM q WHERE len(q) > 0), t),
b AS (SELECT q, arg_min(section, section) FILTER (score = top) AS best, max(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM s WHERE score > 0) GROUP BY q),
j AS (SELECT q.code, CASE WHEN score >= 0.5 THEN best END AS got, round(coalesce(score, 0), 3) AS confidence, CASE WHEN code % 4 = 0 THEN lpad(CAST(code % 60 AS VARCHAR), 6, '0') END AS want FROM q LEFT JOIN b ON b.q = q.q)
SELECT code, CASE WHEN got IS NOT NULL AND (want IS NULL OR got = want) THEN got ELSE want END AS section,
 CASE WHEN got IS NOT NULL AND (want IS NULL OR got = want) THEN 'derived_lexical' WHEN want IS NOT NULL THEN 'override' ELSE 'unresolved' END AS method, confidence,
 CASE WHEN want IS NOT NULL AND got <> want THEN got END AS suggestion, coalesce(want IS NOT NULL AND got <> want, false) AS disputed FROM j"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section's pages and the hash of its text: from the page that its head names to before another section's."""
    lines = M.body_lines(spark, sf_dir)
    pages = lines.groupBy("file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return sections.section_texts(pages, ["file"]).select("file", "section", "start", "pages", F.sha2("body", 256).alias("body_sha256"))


TEXTS_SQL = f"""WITH p AS (SELECT file, page, string_agg(line, chr(10) ORDER BY line_ord) AS text, regexp_extract(string_agg(line, ' ' ORDER BY line_ord) FILTER (line_ord < 8), 'SECTION\\s+(\\d{{6}})\\s*[-–]', 1) AS named FROM {M._BODIES} GROUP BY 1, 2),
s AS (SELECT file, named AS section, min(page) AS start FROM p WHERE named <> '' GROUP BY 1, 2),
w AS (SELECT s.file, s.section, s.start, p.page, p.text, coalesce((SELECT min(o.page) FROM p o WHERE o.file = s.file AND o.page > s.start AND o.page < s.start + 6 AND o.named <> '' AND o.named <> s.section), s.start + 6) AS stop FROM s JOIN p ON p.file = s.file AND p.page >= s.start)
SELECT file, section, start, CAST(count(*) AS INTEGER) AS pages, sha256(string_agg(text, chr(10) ORDER BY page)) AS body_sha256 FROM w WHERE page < stop GROUP BY 1, 2, 3"""

_TITLE = "CASE c_custkey % 4 WHEN 0 THEN 'SUBMITTALS' ELSE 'ACCEPTABLE MANUFACTURERS' END"
_CLAUSE = (
    "'Provide products of:' || '\n' || 'a. ' || c_name || '; ASSA ABLOY.' || '\n' || '1) ' || c_mktsegment || ' Works.; ' || c_name || ' ; x; lower case' || '\n' || '  b. Comply with Requirements of this section' || '\n' || 'abc. No marker' || '\n' || 'c.  ' "
    "|| CASE WHEN c_custkey % 3 = 0 THEN repeat('Long name ', 7) ELSE 'Ab' END || ';Übe Werke'"
)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that clauses on manufacturers list."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"{_TITLE} AS title", f"{_CLAUSE} AS body")
    return c.select("c_custkey", F.array_join(sections.products(F.col("title"), F.col("body")), "|").alias("products"))


PRODUCTS_SQL = f"""WITH l AS (SELECT c_custkey, i, regexp_extract(lines[i], '^\\s*[a-z0-9]{{1,2}}[.)]\\s+(.*)$', 1) AS item FROM (SELECT c_custkey, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT c_custkey, string_split({_CLAUSE}, chr(10)) AS lines FROM customer WHERE contains({_TITLE}, 'MANUFACTURER')))),
n AS (SELECT c_custkey, i, j, trim(regexp_replace(trim(pieces[j]), '\\.+$', '')) AS name FROM (SELECT c_custkey, i, pieces, unnest(range(1, len(pieces) + 1)) AS j FROM (SELECT *, string_split(item, ';') AS pieces FROM l WHERE item <> ''))),
f AS (SELECT c_custkey, name, min(i * 1000 + j) AS at_ FROM n WHERE length(name) BETWEEN 2 AND 60 AND regexp_matches(name, '^\\p{{Lu}}') AND NOT contains(lower(name), ' requirements') GROUP BY 1, 2)
SELECT c.c_custkey, coalesce(string_agg(name, '|' ORDER BY at_), '') AS products FROM customer c LEFT JOIN f ON f.c_custkey = c.c_custkey GROUP BY 1"""


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuals.clauses(M.body_lines(spark, sf_dir), ["file"], ["page", "line_ord"])


def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct standards of every file over all its parts, in order of first mention."""
    return sections.all_standards(_clauses(spark, sf_dir), ["file"]).select("file", F.array_join("standards", ",").alias("standards"))


STANDARDS_SQL = f"""WITH c AS ({M.CLAUSES_SQL}), s AS (SELECT file, ord, unnest(string_split(standards, ',')) AS std, unnest(range(1, len(string_split(standards, ',')) + 1)) AS i FROM c WHERE standards <> ''),
f AS (SELECT file, std, min(ord * 1000 + i) AS at_ FROM s GROUP BY 1, 2) SELECT file, string_agg(std, ',' ORDER BY at_) AS standards FROM f GROUP BY file"""


def clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause 2.04 of every file that has one, the first over all parts."""
    return sections.clause(_clauses(spark, sf_dir), ["file"], "2.04").select("file", "part", "title", "ord", "n_lines")


CLAUSE_SQL = f"SELECT file, part, title, ord, n_lines FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS n FROM ({M.CLAUSES_SQL}) WHERE clause = '2.04') WHERE n = 1"

QUERIES = {"r12_section_map": section_map, "w12_section_texts": texts, "r11_products": products, "a25_standards": standards, "m12_clause": clause}
ORACLE_SQL = {"r12_section_map": MAP_SQL, "w12_section_texts": TEXTS_SQL, "r11_products": PRODUCTS_SQL, "a25_standards": STANDARDS_SQL, "m12_clause": CLAUSE_SQL}
