"""Pages of documents: profiles, runs, regions, located artifacts and completeness.

``documents`` stands for page files: a file is a block of 1,000 ids of one source, a page is a row, and its
page number is its id.  So a source of any size is many files of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.operators import joins, ordered

# Tokens that the synthetic prose has, in place of the anchors of real manuals.
TOKENS = ("THE", "AND", "DER", "QUE")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("file_id"), F.col("doc_id").alias("page_index"), "text", "n_chars", "lang")


_PAGES = "(SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS file_id, doc_id AS page_index, text, n_chars, lang FROM documents)"
_KINDS = f"(SELECT file_id, page_index, CASE WHEN n_chars >= 1500 THEN 'large' ELSE 'letter' END AS kind, n_chars FROM {_PAGES})"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("file_id", "page_index", F.when(F.col("n_chars") >= 1500, "large").otherwise("letter").alias("kind"), "n_chars")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).withColumn("body", X.strip(F.col("text")))
    return p.select("file_id", "page_index", F.length("body").cast("long").alias("char_count"), (F.length("body") >= 20).alias("has_text_layer"), X.short_tokens(F.col("text")).cast("long").alias("short_token_count"), X.size_class(F.col("n_chars").cast("double"), F.lit(612.0)).alias("size_class"))


PROFILE_SQL = f"""SELECT file_id, page_index, length(body) AS char_count, length(body) >= 20 AS has_text_layer,
 len([w FOR w IN string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(w, '[A-Z]{{1,4}}')]) AS short_token_count,
 CASE WHEN greatest(n_chars, 612) < 1000 THEN 'letter' WHEN n_chars >= 1500 THEN 'large' ELSE 'other' END AS size_class
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM {_PAGES})"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select("page_index", F.explode(X.anchor_hits(F.col("text"), TOKENS)).alias("token", "hits"))
    return found.groupBy("token").agg(F.count("*").alias("pages"), F.sum("hits").alias("hits"))


HITS_SQL = f"""SELECT token, count(*) AS pages, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT token, (length(u) - length(replace(u, token, ''))) // length(token) AS hits
 FROM (SELECT upper(text) AS u FROM {_PAGES}), (VALUES {', '.join(f"('{t}')" for t in TOKENS)}) v(token)) WHERE hits > 0 GROUP BY token"""


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.runs(kinds(spark, sf_dir), ["file_id"], "page_index", "kind").withColumn("run", F.col("run").cast("long"))


_RUNS = f"""(SELECT file_id, run, any_value(kind) AS kind, min(page_index) AS first, max(page_index) AS last, count(*) AS n FROM
 (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_id ORDER BY page_index) - 1 AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY file_id ORDER BY page_index) = kind THEN 0 ELSE 1 END AS fresh FROM {_KINDS})) GROUP BY file_id, run)"""


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.regions(kinds(spark, sf_dir), ["file_id"], "page_index", "kind", 3)


def absorbed_sql(pages: str, large: str = "drawings", small: str = "manual", least: int = 3) -> str:
    """WITH RECURSIVE parts that end in ``region`` (file_id, kind, page_start, page_end, pages) of ``pages`` (file_id, page_index, kind: d for large pages, m for small ones).

    A file is a string of letters; as long as an inner run is short and its neighbours agree, the first such run takes their letter.
    """
    return f"""line AS (SELECT file_id, string_agg(kind, '' ORDER BY page_index) AS s, list(page_index ORDER BY page_index) AS idx FROM {pages} GROUP BY file_id),
step(file_id, s, idx) AS (SELECT file_id, s, idx FROM line UNION ALL
 SELECT file_id, array_to_string(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = j THEN repeat(left(r[i - 1], 1), length(r[i])) ELSE r[i] END), ''), idx FROM
 (SELECT *, list_filter(range(2, len(r)), lambda i: length(r[i]) < {least})[1] AS j FROM (SELECT *, regexp_extract_all(s, 'm+|d+') AS r FROM step)) WHERE j IS NOT NULL),
last_step AS (SELECT file_id, idx, regexp_extract_all(s, 'm+|d+') AS r FROM step WHERE len(list_filter(range(2, len(regexp_extract_all(s, 'm+|d+'))), lambda i: length(regexp_extract_all(s, 'm+|d+')[i]) < {least})) = 0),
cut AS (SELECT file_id, idx, r[i] AS run, CAST(list_sum(list_transform(r[1:i - 1], lambda x: length(x))) AS BIGINT) AS before FROM (SELECT file_id, idx, r, unnest(range(1, len(r) + 1)) AS i FROM last_step)),
region AS (SELECT file_id, CASE left(run, 1) WHEN 'd' THEN '{large}' ELSE '{small}' END AS kind, idx[coalesce(before, 0) + 1] AS page_start, idx[coalesce(before, 0) + length(run)] AS page_end, CAST(length(run) AS BIGINT) AS pages FROM cut)"""


REGIONS_SQL = f"WITH RECURSIVE page AS (SELECT file_id, page_index, CASE kind WHEN 'large' THEN 'd' ELSE 'm' END AS kind FROM {_KINDS}), {absorbed_sql('page', 'large', 'letter')} SELECT * FROM region"


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = kinds(spark, sf_dir).withColumn("page_index", F.floor(F.col("page_index") / 20)).filter("kind = 'large'").groupBy("file_id", "page_index").agg(F.sum("n_chars").alias("n_chars"))
    return ordered.longest_run(near, ["file_id"], "page_index", "n_chars")


LONGEST_SQL = f"""WITH p AS (SELECT file_id, page_index // 20 AS page_index, sum(n_chars) AS w FROM {_KINDS} WHERE kind = 'large' GROUP BY 1, 2),
i AS (SELECT file_id, min(page_index) AS page_start, max(page_index) AS page_end, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight FROM
 (SELECT *, page_index - row_number() OVER (PARTITION BY file_id ORDER BY page_index) AS island FROM p) GROUP BY file_id, island)
SELECT file_id, page_start, page_end, n, weight FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, weight DESC, page_start) AS r FROM i) WHERE r = 1"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages inside runs of large pages, as a range semi-join."""
    k = kinds(spark, sf_dir)
    large = ordered.runs(k, ["file_id"], "page_index", "kind").filter("kind = 'large' and n >= 2").select("file_id", F.col("first").alias("page_start"), F.col("last").alias("page_end"))
    return joins.in_ranges(k.select("file_id", "page_index"), large, "file_id", "page_index")


LOCATED_SQL = f"SELECT file_id, page_index FROM {_KINDS} p WHERE EXISTS (SELECT 1 FROM {_RUNS} r WHERE r.kind = 'large' AND r.n >= 2 AND r.file_id = p.file_id AND p.page_index BETWEEN r.first AND r.last)"


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts found of those expected; an artifact whose region is missing does not apply."""
    p = pages(spark, sf_dir)
    per = p.groupBy("file_id").agg(*(F.max(F.contains(F.upper("text"), F.lit(t)).cast("int")).alias(t) for t in TOKENS), F.max((F.col("n_chars") >= 1500).cast("int")).alias("large"))
    status = [F.struct(F.lit(t).alias("name"), F.when((F.col("large") == 0) & F.lit(i > 1), "not_applicable").when(F.col(t) == 1, "found").otherwise("absent").alias("status")) for i, t in enumerate(TOKENS)]
    listed = per.select("file_id", F.explode(F.array(*status)).alias("a"))
    n = lambda s: F.count_if(F.col("a.status") == s)
    return listed.groupBy("file_id").agg(n("found").alias("found"), n("absent").alias("absent"), n("not_applicable").alias("not_applicable"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("a.status") == "absent", F.col("a.name"))))).alias("missing"))


COMPLETENESS_SQL = f"""WITH f AS (SELECT file_id, max(CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END) AS large, {', '.join(f"max(CASE WHEN contains(upper(text), '{t}') THEN 1 ELSE 0 END) AS h{i}" for i, t in enumerate(TOKENS))} FROM {_PAGES} GROUP BY file_id),
s AS ({' UNION ALL '.join(f"SELECT file_id, '{t}' AS name, CASE WHEN large = 0 AND {i} > 1 THEN 'not_applicable' WHEN h{i} = 1 THEN 'found' ELSE 'absent' END AS status FROM f" for i, t in enumerate(TOKENS))})
SELECT file_id, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'absent') AS absent, count(*) FILTER (status = 'not_applicable') AS not_applicable,
 coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'absent'), '') AS missing FROM s GROUP BY file_id"""


#: How many pages of a file decide its format.
SAMPLED = 10


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with page count, format by the text of sampled pages, and a checksum of their pages' checksums in order.

    Every n/10th page of a file is looked at, all of a file of fewer than twenty; a file without pages is unknown.
    """
    at = Window.partitionBy("file_id").orderBy("page_index")
    step = F.greatest(F.floor(F.col("_n") / SAMPLED), F.lit(1))
    p = pages(spark, sf_dir).withColumn("_i", F.row_number().over(at) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("file_id")))
    sampled = (F.col("_i") % step == 0) & (F.length(X.strip(F.col("text"))) >= 20)
    sums = F.array_sort(F.collect_list(F.struct("_i", F.sha2("text", 256).alias("s"))))
    per = p.groupBy("file_id").agg(F.count("*").alias("page_count"), F.max(F.coalesce(sampled, F.lit(False))).alias("vector"), F.sha2(F.array_join(F.transform(sums, lambda x: x["s"]), ""), 256).alias("checksum"))
    return per.select("file_id", "page_count", F.when(F.col("page_count") == 0, "unknown").when(F.col("vector"), "pdf_vector").otherwise("pdf_scanned").alias("doc_format"), "checksum")


INTAKE_SQL = f"""SELECT file_id, count(*) AS page_count, CASE WHEN bool_or(i % greatest(n // {SAMPLED}, 1) = 0 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20) THEN 'pdf_vector' ELSE 'pdf_scanned' END AS doc_format,
 sha256(string_agg(sha256(text), '' ORDER BY i)) AS checksum FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_index) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM {_PAGES}) GROUP BY file_id"""


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content dedup: one active row for each checksum, the first by id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return docs.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


CHECKSUMS_SQL = "SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines stand under each line of fewer than 60 characters, the last such line before them."""
    lines = pages(spark, sf_dir).select("page_index", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heads = lines.withColumn("head", F.when(F.length("line") < 60, F.col("pos")))
    return ordered.carry(heads, ["page_index"], "pos", "head", "under").groupBy("under").agg(F.count("*").alias("lines"))


CARRIED_SQL = f"""SELECT under, count(*) AS lines FROM (SELECT last_value(head IGNORE NULLS) OVER (PARTITION BY page_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS under FROM
 (SELECT page_index, i - 1 AS pos, CASE WHEN length(l[i]) < 60 THEN CAST(i - 1 AS INTEGER) END AS head FROM (SELECT page_index, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_index, string_split(text, chr(10)) AS l FROM {_PAGES})))) GROUP BY under"""


def shard_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    high = docs.agg(F.max("doc_id")).first()[0]
    return ordered.windows(docs.filter("n_chars >= 3000"), "doc_id", 0, (high if high is not None else -1) + 1, 31)


WINDOWS_SQL = """WITH c AS (SELECT DISTINCT doc_id AS p FROM documents WHERE n_chars >= 3000), r AS (SELECT p, (row_number() OVER (ORDER BY p) - 1) // 31 AS index FROM c),
w AS (SELECT index, max(p) AS last, count(*) AS candidates FROM r GROUP BY index)
SELECT index, coalesce(lag(last) OVER (ORDER BY index) + 1, 0) AS start, CASE WHEN lead(last) OVER (ORDER BY index) IS NULL THEN (SELECT max(doc_id) + 1 FROM documents) ELSE last + 1 END AS "end", candidates FROM w"""

QUERIES = {
    "f1_page_profile": profile, "f3_anchor_hits": hits, "w1_page_runs": page_runs, "w3_regions": page_regions, "w5_longest_run": longest, "j1_located_pages": located,
    "a6_completeness": completeness, "s9_intake": intake, "d7_content_dedup": checksums, "w9_carried_heads": carried, "p1_shard_windows": shard_windows,
}
ORACLE_SQL = {
    "f1_page_profile": PROFILE_SQL, "f3_anchor_hits": HITS_SQL, "w1_page_runs": f"SELECT * FROM {_RUNS}", "w3_regions": REGIONS_SQL, "w5_longest_run": LONGEST_SQL, "j1_located_pages": LOCATED_SQL,
    "a6_completeness": COMPLETENESS_SQL, "s9_intake": INTAKE_SQL, "d7_content_dedup": CHECKSUMS_SQL, "w9_carried_heads": CARRIED_SQL, "p1_shard_windows": WINDOWS_SQL,
}
