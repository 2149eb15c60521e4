"""Transcripts: token accounting, masking, cuts, loops, retrieval and permissions on conversations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import normalize
from plumbline.operators import joins, ordered, retrieval
from plumbline.sources.tables import stored

K1, B = 1.5, 0.75
#: Query terms that are broadcast at most.
MOST_TERMS = 500_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_count(text: Column) -> Column:
    """The default token counter: words between blanks."""
    return F.size(F.split(F.coalesce(text, F.lit("")), " "))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by role with four more for each message, utilisation of a window and its state."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "role", (token_count(F.col("text")) + 4).alias("t"))
    of = lambda r: F.sum(F.when(F.col("role") == r, F.col("t")).otherwise(0)).alias(r)
    s = c.groupBy("conv_id").agg(of("system"), of("user"), of("assistant"), F.sum("t").alias("total"))
    return s.withColumn("state", F.when(F.col("total") >= 0.8 * 600, "red").when(F.col("total") >= 0.6 * 600, "amber").otherwise("green"))


SNAPSHOT_SQL = """SELECT conv_id, CAST(sum(CASE WHEN role = 'system' THEN t ELSE 0 END) AS BIGINT) AS system, CAST(sum(CASE WHEN role = 'user' THEN t ELSE 0 END) AS BIGINT) AS user, CAST(sum(CASE WHEN role = 'assistant' THEN t ELSE 0 END) AS BIGINT) AS assistant, CAST(sum(t) AS BIGINT) AS total,
 CASE WHEN sum(t) >= 480 THEN 'red' WHEN sum(t) >= 360 THEN 'amber' ELSE 'green' END AS state FROM (SELECT conv_id, role, len(string_split(text, ' ')) + 4 AS t FROM conversations) GROUP BY conv_id"""


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant rows stand for results: all but the last two of a conversation become a stub; tokens freed are summed."""
    c = _t(spark, sf_dir, "conversations").filter("role = 'assistant'")
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    old = c.withColumn("r", F.row_number().over(late)).filter("r > 2")
    return old.groupBy("conv_id").agg(F.count("*").alias("masked"), F.sum(F.greatest(token_count(F.col("text")) - 3, F.lit(0))).alias("freed"))


MASKED_SQL = "SELECT conv_id, count(*) AS masked, CAST(sum(greatest(len(string_split(text, ' ')) - 3, 0)) AS BIGINT) AS freed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r > 2 GROUP BY conv_id"


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a summary of old turns ends: the first turn and the last four stay, and the kept part begins with no result."""
    c = _t(spark, sf_dir, "conversations")
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = c.withColumn("i", F.row_number().over(at)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    kept = n.filter((F.col("i") > 1) & (F.col("i") <= F.greatest(F.col("n") - 3, F.lit(2))) & (F.col("role") != "assistant"))
    return kept.groupBy("conv_id").agg(F.max("i").alias("kept_from"), F.max("n").alias("n")).select("conv_id", "kept_from", (F.col("kept_from") - 2).alias("summarised"))


CUT_SQL = """SELECT conv_id, CAST(max(i) AS INTEGER) AS kept_from, CAST(max(i) - 2 AS INTEGER) AS summarised FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
 WHERE i > 1 AND i <= greatest(n - 3, 2) AND role <> 'assistant' GROUP BY conv_id"""


def last_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return ordered.first_wins(c, ["conv_id"], [F.desc("turn"), F.desc("text")]).select("conv_id", "turn", "text")


LAST_SQL = "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1"


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user's last three calls are alike."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    at = Window.partitionBy("user_id").orderBy("event_id")
    return e.withColumn("a", F.lag("event_type", 1).over(at)).withColumn("b", F.lag("event_type", 2).over(at)).filter("event_type = a and event_type = b").select("event_id", "user_id", "event_type")


LOOPS_SQL = "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = a AND event_type = b"


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status gauges, with a value read from the JSON properties."""
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"), F.countDistinct("user_id").alias("users"))


STATUS_SQL = "SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"


def scored(spark: SparkSession, sf_dir: str, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, score of each benchmark text's ``k`` best documents, by Okapi BM25 (k1 = 1.5, b = 0.75), and of all ``wanted`` (item_id, doc_id); not scores of zero or less.

    Every query token counts, as often as it occurs; among equal scores the least doc_id is best.  Documents are read and
    split once: the terms that queries have are written with their counts and the document's length, and an empty term
    stands for the document itself.
    """
    split = lambda c: F.filter(F.split(normalize(F.col(c)), " "), lambda w: w != "")
    asked_of = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(split("text")).alias("term"))
    query = asked_of.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    asked = query.select("term").unionByName(spark.createDataFrame([("",)], "term string")).distinct()
    # A term that no query has is dropped before anything is shuffled, if the asked terms are few enough to broadcast.
    asked = F.broadcast(asked) if asked.count() <= MOST_TERMS else asked
    words = _t(spark, sf_dir, "documents").select("doc_id", split("text").alias("w"))
    words = words.select("doc_id", F.size("w").alias("dl"), F.explode(F.concat("w", F.array(F.lit("")))).alias("term"))
    counted = stored(words.join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "bm25-tf")
    total = counted.filter("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    tf = counted.filter("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # total is one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked_for = stored(query.join(df, "term").select("item_id", "term", (F.col("times") * idf).alias("idf"), "mean"), "bm25-query")
    return retrieval.best(asked_for, tf, k, K1, B, wanted)


def bm25(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k best documents for each benchmark text."""
    return scored(spark, sf_dir, k).select("item_id", "doc_id", F.round("score", 6).alias("score"))


BM25_SQL = f"""WITH norm AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), tok AS (SELECT doc_id, unnest(w) AS term FROM norm),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY ALL), size AS (SELECT doc_id, len([x FOR x IN w IF x <> '']) AS dl FROM norm), total AS (SELECT count(*) AS n, avg(dl) AS mean FROM size),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM benchmark) WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), 9) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 5"""


def best_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored match: the names of nations against those of regions, by shared beginnings of words."""
    toks = lambda c: F.filter(F.split(normalize(c), " "), lambda w: w != "")
    q = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), toks(F.col("n_name")).alias("tokens"))
    t = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("title_id"), toks(F.concat_ws(" ", "r_name", F.lit("nation"))).alias("tokens"))
    return joins.best_title(q, t, 0.2)


BEST_SQL = """WITH q AS (SELECT n_nationkey::BIGINT AS query_id, [x FOR x IN string_split(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), ' ') IF x <> ''] AS q FROM nation),
t AS (SELECT r_regionkey::BIGINT AS title_id, [x FOR x IN string_split(trim(regexp_replace(lower(r_name || ' nation'), '[^a-z0-9]+', ' ', 'g')), ' ') IF x <> ''] AS t FROM region),
s AS (SELECT query_id, title_id, len([a FOR a IN q IF len([b FOR b IN t IF a = b OR (least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)))]) > 0]) / len(q) AS score FROM q, t)
SELECT query_id, title_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title_id) AS r FROM s WHERE score > 0.2) WHERE r = 1"""


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by side effect: the most restrictive rule wins, an unknown effect asks, and asking is denying without a user."""
    rules = {"view": 0, "click": 0, "purchase": 1, "refund": 2}
    rank = F.expr("CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.items()) + " ELSE 1 END")
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(rank).alias("r"))
    return e.select("user_id", F.when(F.col("r") == 0, "allow").otherwise("deny").alias("decision"))


PERMISSIONS_SQL = "SELECT user_id, CASE WHEN max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'refund' THEN 2 ELSE 1 END) = 0 THEN 'allow' ELSE 'deny' END AS decision FROM events GROUP BY user_id"

QUERIES = {"a23_snapshot": snapshot, "w19_masked": masked, "w20_cut": cut, "w22_last_text": last_texts, "w21_loops": loops, "a22_status": status, "d11_bm25": bm25, "j15_best_title": best_titles, "x7_permissions": permissions}
ORACLE_SQL = {"a23_snapshot": SNAPSHOT_SQL, "w19_masked": MASKED_SQL, "w20_cut": CUT_SQL, "w22_last_text": LAST_SQL, "w21_loops": LOOPS_SQL, "a22_status": STATUS_SQL, "d11_bm25": BM25_SQL, "j15_best_title": BEST_SQL, "x7_permissions": PERMISSIONS_SQL}
