"""Blocks of transcripts, plans, tools and verdicts on the driver's tables.

Events of a user are blocks of a conversation, orders are plans with their lines as steps and conditions, parts are tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import transcripts as T
from plumbline.plans.transcripts import BM25_SQL, scored

_BLOCK = {
    "conv_id": "user_id", "turn": "CAST(floor(event_id / 3) AS BIGINT)", "block_ord": "event_id % 3", "role": "CASE WHEN event_type IN ('view', 'error') THEN 'user' ELSE 'assistant' END",
    "kind": "CASE event_type WHEN 'click' THEN 'call' WHEN 'error' THEN 'result' ELSE 'text' END", "text": "CASE WHEN event_type = 'click' THEN NULL ELSE event_type || ' ' || props || repeat(' more', CAST(event_id % 200 AS INTEGER)) END",
    "call_id": "CASE WHEN event_type IN ('click', 'error') THEN CAST(event_id % 50 AS STRING) END", "name": "CASE WHEN event_type = 'click' THEN 'tool' || CAST(event_id % 4 AS STRING) END", "args": "CASE WHEN event_type = 'click' THEN props END",
}


def _made(spark: SparkSession, sf_dir: str, table: str, of: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {n}" for n, e in of.items()))


def _sql(of: dict[str, str], table: str) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in of.items()) + f" FROM {table})"


def without_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without results whose call is not in the conversation; a message that this empties is gone."""
    kept = T.without_orphans(_made(spark, sf_dir, "events", _BLOCK))
    return kept.groupBy("conv_id", "turn").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "result").alias("results"))


ORPHANS_SQL = f"""WITH b AS {_sql(_BLOCK, 'events')} SELECT conv_id, turn, count(*) AS blocks, count(*) FILTER (kind = 'result') AS results FROM b
WHERE kind <> 'result' OR EXISTS (SELECT 1 FROM b c WHERE c.kind = 'call' AND c.conv_id = b.conv_id AND c.call_id = b.call_id) GROUP BY 1, 2"""


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query text of every conversation: its first message, and the assistant's blocks among the last six messages."""
    return T.query_text(_made(spark, sf_dir, "events", _BLOCK))


QUERY_SQL = f"""WITH b AS {_sql(_BLOCK, 'events')}, m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (SELECT DISTINCT conv_id, turn FROM b)),
p AS (SELECT b.conv_id, 0 AS o, b.turn, block_ord, text AS t FROM b JOIN m ON m.conv_id = b.conv_id AND m.turn = b.turn WHERE i = 1 AND kind = 'text'
 UNION ALL SELECT b.conv_id, 1, b.turn, block_ord, CASE kind WHEN 'call' THEN name || ' [''' || array_to_string(json_keys(args), ''', ''') || ''']' ELSE substr(text, 1, 500) END FROM b JOIN m ON m.conv_id = b.conv_id AND m.turn = b.turn WHERE r <= 6 AND role = 'assistant' AND kind IN ('text', 'call'))
SELECT conv_id, string_agg(t, ' ' ORDER BY o, turn, block_ord) AS query FROM p GROUP BY conv_id"""

_PLAN = {"plan_id": "o_orderkey", "objective": "'Order of ' || o_orderpriority"}
_STEP = {
    "plan_id": "l_orderkey", "step": "CAST(l_partkey * 10 + l_linenumber AS BIGINT)", "description": "'ship ' || CAST(l_partkey AS STRING)", "status": "CASE WHEN l_returnflag = 'R' THEN 'blocked' WHEN l_partkey % 5 = 0 THEN 'pending' WHEN l_partkey % 7 = 0 THEN 'in_progress' ELSE 'done' END",
    "evidence": "CASE WHEN l_suppkey % 3 = 0 THEN 'by ' || CAST(l_suppkey AS STRING) WHEN l_suppkey % 3 = 1 THEN '' END", "notes": "CASE WHEN l_suppkey % 4 = 0 THEN l_linestatus END",
}
_CONDITION = {"plan_id": "o_orderkey", "condition": "CAST(1 AS BIGINT)", "description": "'paid by ' || CAST(o_custkey AS STRING)", "satisfied": "o_orderstatus <> 'P' AND o_custkey % 3 <> 0", "evidence": "CASE WHEN o_custkey % 2 = 0 THEN 'receipt' END"}


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(_made(spark, sf_dir, t, of) for t, of in (("orders", _PLAN), ("lineitem", _STEP), ("orders", _CONDITION)))


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that may be finished: every step is done or blocked, every condition holds; and how many steps are open."""
    _, steps, conditions = _plans(spark, sf_dir)
    return T.plan_ready(steps, conditions).select("plan_id", "ready", F.size("open").alias("open"))


_ALL = f"WITH p AS {_sql(_PLAN, 'orders')}, s AS {_sql(_STEP, 'lineitem')}, c AS {_sql(_CONDITION, 'orders')}"
READY_SQL = f"""{_ALL} SELECT s.plan_id, bool_and(status IN ('done', 'blocked')) AND coalesce(any_value(satisfied), true) AS ready, CAST(count(*) FILTER (status NOT IN ('done', 'blocked')) AS INTEGER) AS open
FROM s LEFT JOIN c ON c.plan_id = s.plan_id GROUP BY 1"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, steps, conditions = _plans(spark, sf_dir)
    return T.open_items(steps, conditions)


NOTES_SQL = f"""{_ALL}, l AS (SELECT plan_id, 0 AS o, step AS i, '  - step not done: ' || description AS line FROM s WHERE status NOT IN ('done', 'blocked') UNION ALL SELECT plan_id, 1, condition, '  - postcondition not verified: ' || description FROM c WHERE NOT satisfied)
SELECT plan_id, '[stopped: plan not verified complete]' || chr(10) || string_agg(line, chr(10) ORDER BY o, i, line) AS note FROM l GROUP BY 1"""


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plan_text(*_plans(spark, sf_dir))


TEXTS_SQL = f"""{_ALL}, sl AS (SELECT plan_id, string_agg(line, '' ORDER BY step, line) AS t FROM (SELECT plan_id, step, chr(10) || step || '. ' || CASE status WHEN 'pending' THEN '[ ]' WHEN 'in_progress' THEN '[.]' WHEN 'done' THEN '[x]' ELSE '[!]' END || ' ' || description
  || CASE WHEN evidence <> '' THEN chr(10) || '     evidence: ' || evidence ELSE '' END || CASE WHEN notes <> '' THEN chr(10) || '     notes: ' || notes ELSE '' END AS line FROM s) GROUP BY 1)
SELECT p.plan_id, '# Plan: ' || objective || chr(10) || chr(10) || '## Steps' || coalesce(t, '') || chr(10) || chr(10) || '## Postconditions' || chr(10) || '1. ' || CASE WHEN satisfied THEN '[x]' ELSE '[ ]' END || ' ' || description
 || CASE WHEN evidence <> '' THEN chr(10) || '     evidence: ' || evidence ELSE '' END AS text FROM p JOIN c ON c.plan_id = p.plan_id LEFT JOIN sl ON sl.plan_id = p.plan_id"""

_WANTED = {"agent": "l_orderkey", "tool": "'tool' || CAST(l_partkey AS STRING)"}


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of every sub-agent (order): the wanted parts that are in the catalogue, without those for delegation."""
    named = lambda where: spark.read.parquet(f"{sf_dir}/part.parquet").filter(where).selectExpr("'tool' || CAST(p_partkey AS STRING) AS tool")
    return T.allowed(named("p_size % 3 <> 0"), _made(spark, sf_dir, "lineitem", _WANTED), named("p_size % 7 = 0"))


TOOLS_SQL = f"""WITH w AS (SELECT DISTINCT * FROM {_sql(_WANTED, 'lineitem')}), t AS (SELECT 'tool' || p_partkey AS tool FROM part WHERE p_size % 3 <> 0 AND p_size % 7 <> 0), h AS (SELECT agent, w.tool FROM w JOIN t ON t.tool = w.tool)
SELECT agent, tool, NULL AS error FROM h UNION ALL SELECT DISTINCT agent, NULL, 'none of the wanted tools is available' FROM w WHERE agent NOT IN (SELECT agent FROM h)"""

_ANSWER = {
    "symbol_id": "event_id", "failed": "event_type = 'error'", "count": "CASE event_id % 5 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN ' 12 ' WHEN 2 THEN 'many' WHEN 3 THEN '3.5' END",
    "agrees": "CASE WHEN user_id % 2 = 0 THEN 'true' WHEN user_id % 3 = 0 THEN 'false' END", "confidence": "CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN '0.25' WHEN 2 THEN '-1' END", "notes": "CASE WHEN event_id % 3 = 0 THEN props END",
}


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.verdicts(_made(spark, sf_dir, "events", _ANSWER))


VERDICTS_SQL = f"""SELECT symbol_id, NOT failed AS verified, NOT failed AND n IS NOT NULL AND coalesce(agrees = 'true', false) AS agrees, CASE WHEN NOT failed THEN n END AS verified_count,
 CASE WHEN failed THEN 0 ELSE greatest(0, least(1, coalesce(CAST(confidence AS DOUBLE), 0))) END AS confidence, CASE WHEN failed THEN 'verifier_error' ELSE coalesce(notes, '') END AS notes
FROM (SELECT *, CASE WHEN regexp_full_match(count, '\\s*[+-]?\\d+\\s*') THEN CAST(trim(count) AS INTEGER) END AS n FROM {_sql(_ANSWER, 'events')})"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on calls in the sessions of users: what was allowed once stays allowed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    calls = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.col("event_id").alias("call_id"), F.col("event_type").alias("name"), F.create_map(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("args"), F.array("event_type").alias("effects"))
    rules = spark.createDataFrame([("view", "allow"), ("click", "ask"), ("error", "deny")], "effect string, decision string")
    answers = e.filter("event_id % 4 <> 0").select(F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 4 == 1, "allow").otherwise("deny").alias("answer"))
    return T.decide_in_session(calls, rules, answers)


SESSIONS_SQL = """WITH c AS (SELECT user_id, event_id, event_type, event_id % 3 AS k, CASE event_type WHEN 'view' THEN 'allow' WHEN 'error' THEN 'deny' ELSE 'ask' END AS d, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'allow' ELSE 'deny' END AS a FROM events),
f AS (SELECT *, event_id > min(CASE WHEN d = 'ask' AND a = 'allow' THEN event_id END) OVER (PARTITION BY user_id, event_type, k) AS before FROM c)
SELECT event_id AS call_id, CASE WHEN before THEN 'allow' WHEN d <> 'ask' THEN d ELSE coalesce(a, 'deny') END AS decision, CASE WHEN before THEN 'approved before' WHEN d <> 'ask' THEN 'rule' WHEN a IS NULL THEN 'nobody to ask' ELSE 'user' END AS reason FROM f"""


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents for each benchmark text: two pinned ones first, whatever they score, then the best."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    wanted = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(F.array(F.col("item_id") * 3, F.col("item_id") * 3 + 1)).alias("doc_id"))
    wanted = wanted.join(docs, "doc_id", "left_semi")
    out = T.pinned_top(scored(spark, sf_dir, 7, wanted), wanted, ["item_id"], "doc_id", 7)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_SCORED = BM25_SQL[: BM25_SQL.rindex("\nSELECT item_id")]
PINNED_SQL = f"""{_SCORED}, p AS (SELECT item_id, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id IN (item_id * 3, item_id * 3 + 1)),
j AS (SELECT coalesce(s.item_id, p.item_id) AS item_id, coalesce(s.doc_id, p.doc_id) AS doc_id, score, p.doc_id IS NOT NULL AS pin FROM (SELECT * FROM s WHERE score > 0) s FULL JOIN p ON p.item_id = s.item_id AND p.doc_id = s.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pin DESC, score DESC NULLS LAST, doc_id) AS INTEGER) AS rank, count(*) FILTER (pin) OVER (PARTITION BY item_id) AS n FROM j)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= greatest(n, 7)"""

_RESPONSE = {
    "conv_id": "user_id", "turn": "event_id", "text": "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END", "reasoning": "CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '' END",
}


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of assistant messages: reasoning first, then the calls, or else the text."""
    call = "CASE WHEN event_type IN ('click', 'purchase') THEN transform(sequence(1, CAST(event_id % 3 AS INT) + 1), i -> named_struct('id', concat(event_id, '-', i), 'name', event_type, 'args', props)) END AS calls"
    r = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{e} AS {n}" for n, e in _RESPONSE.items()), call)
    return T.assistant_blocks(r)


BLOCKS_SQL = f"""WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RESPONSE.items())}, event_type, event_id, props, event_type IN ('click', 'purchase') AS called FROM events),
b AS (SELECT conv_id, turn, 0 AS o, 'reasoning' AS kind, reasoning AS text, NULL AS call_id, NULL AS name, NULL AS args FROM r WHERE reasoning <> '' UNION ALL SELECT conv_id, turn, i, 'call', NULL, event_id || '-' || i, event_type, props FROM (SELECT *, unnest(range(1, event_id % 3 + 2)) AS i FROM r WHERE called)
 UNION ALL SELECT conv_id, turn, 1, 'text', coalesce(text, ''), NULL, NULL, NULL FROM r WHERE NOT called) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS INTEGER) AS block_ord, kind, text, call_id, name, args FROM b"""

_CALL = {"call_id": "event_id", "name": "event_type", "args": "CASE event_id % 6 WHEN 0 THEN props || repeat('x', 300) WHEN 1 THEN '[1]' WHEN 2 THEN '{\"page\": 1}' WHEN 3 THEN '{' ELSE props END"}


def bad_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose arguments are no JSON object, or lack a field that their tool asks for."""
    required = spark.createDataFrame([("view", "k"), ("view", "page"), ("click", "k"), ("error", "page")], "name string, field string")
    return T.argument_errors(_made(spark, sf_dir, "events", _CALL), required)


ARGUMENTS_SQL = f"""WITH c AS {_sql(_CALL, 'events')}, q AS (SELECT * FROM (VALUES ('view', 'k'), ('view', 'page'), ('click', 'k'), ('error', 'page')) v(name, field)),
j AS (SELECT *, json_valid(args) AND starts_with(args, '{{') AS ok, (SELECT string_agg(field, ', ' ORDER BY field) FROM q WHERE q.name = c.name AND NOT (CASE WHEN json_valid(args) THEN list_contains(json_keys(args), field) ELSE false END)) AS missing FROM c)
SELECT call_id, CASE WHEN NOT ok THEN name || ': arguments were not valid JSON: ' || CASE WHEN length(args) > 200 THEN left(args, 200) || '…' ELSE args END ELSE name || ': invalid arguments, missing ' || missing END AS error FROM j WHERE NOT ok OR missing IS NOT NULL"""

QUERIES = {
    "m16_blocks": blocks, "m20_arguments": bad_arguments, "j21_without_orphans": without_orphans, "w23_query_texts": query_texts, "x10_plan_ready": ready, "m18_open_items": notes, "m19_plan_texts": plan_texts, "j23_allowed_tools": tools, "m13_verdicts": verdicts,
    "m21_sessions": sessions, "d11_pinned": pinned,
}
ORACLE_SQL = {
    "m16_blocks": BLOCKS_SQL, "m20_arguments": ARGUMENTS_SQL, "j21_without_orphans": ORPHANS_SQL, "w23_query_texts": QUERY_SQL, "x10_plan_ready": READY_SQL, "m18_open_items": NOTES_SQL, "m19_plan_texts": TEXTS_SQL, "j23_allowed_tools": TOOLS_SQL, "m13_verdicts": VERDICTS_SQL,
    "m21_sessions": SESSIONS_SQL, "d11_pinned": PINNED_SQL,
}
