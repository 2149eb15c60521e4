"""Transcripts as block tables (conv_id, turn, block_ord, role, kind, text, call_id, name, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ordered import first_wins, top

ORDER = ["turn", "block_ord"]
# States of a step that need no more work.
TERMINAL = ("done", "blocked")


def without_orphans(blocks: DataFrame) -> DataFrame:
    """Results whose call is not there go, and with them messages that this empties."""
    calls = blocks.filter("kind = 'call'").select("conv_id", "call_id").distinct()
    results = blocks.filter("kind = 'result'").join(calls, ["conv_id", "call_id"], "left_semi")
    return blocks.filter("kind is null or kind <> 'result'").unionByName(results.select(*blocks.columns))


def masked(blocks: DataFrame, keep: int, stub: str, count: Column | None = None) -> DataFrame:
    """All but the last ``keep`` results of a conversation become ``stub``; freed tells the tokens saved; masked ones stay."""
    count = F.size(F.split("text", " ")) if count is None else count
    late = Window.partitionBy("conv_id", "kind").orderBy(*(F.desc(c) for c in ORDER))
    old = (F.col("kind") == "result") & (F.col("_r") > keep) & (F.col("text") != stub)
    rows = blocks.withColumn("_r", F.row_number().over(late)).withColumn("_old", F.coalesce(old, F.lit(False)))
    freed = F.when(F.col("_old"), F.greatest(count - len(stub.split(" ")), F.lit(0))).otherwise(0)
    return rows.withColumn("freed", freed).withColumn("text", F.when(F.col("_old"), stub).otherwise(F.col("text"))).drop("_r", "_old")


def loops(blocks: DataFrame, times: int = 3) -> DataFrame:
    """conv_id, name of conversations whose last ``times`` calls are alike in name and arguments."""
    last = top(blocks.filter("kind = 'call'"), ["conv_id"], [F.desc(c) for c in ORDER], times)
    return last.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct(F.struct("name", F.coalesce("args", F.lit("")))).alias("d"), F.max("name").alias("name")).filter((F.col("n") == times) & (F.col("d") == 1)).select("conv_id", "name")


def query_text(blocks: DataFrame, recent: int = 6, most: int = 500) -> DataFrame:
    """conv_id, query: the texts of the first message, then what the assistant said and called in the last messages.

    A text of the assistant is cut to ``most`` characters, each by itself (a parameter, as that is the feature); a call is
    its name and its argument keys (``args`` is JSON text).
    """
    messages = blocks.select("conv_id", "turn").distinct()
    asc, late = (Window.partitionBy("conv_id").orderBy(o) for o in (F.asc("turn"), F.desc("turn")))
    placed = messages.withColumn("_i", F.row_number().over(asc)).withColumn("_r", F.row_number().over(late))
    rows = blocks.join(placed, ["conv_id", "turn"])
    first = (F.col("_i") == 1) & (F.col("kind") == "text")
    near = (F.col("_r") <= recent) & (F.col("role") == "assistant") & F.col("kind").isin("text", "call")
    keys = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>")), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    said = F.when(F.col("kind") == "call", F.concat_ws(" ", "name", keys)).otherwise(F.substring("text", 1, most))
    parts = F.array_compact(F.array(F.when(first, F.struct(F.lit(0).alias("o"), "turn", "block_ord", F.col("text").alias("t"))), F.when(near, F.struct(F.lit(1).alias("o"), "turn", "block_ord", said.alias("t")))))
    listed = rows.select("conv_id", F.explode(parts).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("_t"))
    return listed.select("conv_id", F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias("query"))


def last_text(blocks: DataFrame) -> DataFrame:
    said = blocks.filter("role = 'assistant' and kind = 'text'")
    return first_wins(said, ["conv_id"], [F.desc(c) for c in ORDER]).select("conv_id", "text")


def plan_ready(steps: DataFrame, conditions: DataFrame) -> DataFrame:
    """plan_id, ready, open: a plan is ready when every step is done or blocked and every condition holds."""
    ended = F.col("status").isin(*TERMINAL)
    s = steps.groupBy("plan_id").agg(F.min(ended).alias("_s"), F.array_sort(F.collect_list(F.when(~ended, F.col("step")))).alias("open"))
    c = conditions.groupBy("plan_id").agg(F.min("satisfied").alias("_c"))
    return s.join(c, "plan_id", "left").select("plan_id", (F.col("_s") & F.coalesce("_c", F.lit(True))).alias("ready"), "open")


def decide(calls: DataFrame, rules: DataFrame, interactive: bool = False) -> DataFrame:
    """call_id, decision: the most restrictive rule of a call's side effects; none asks, and asking nobody denies."""
    rank = F.when(F.col("decision") == "deny", 2).when(F.col("decision") == "ask", 1).otherwise(0)
    j = calls.select("call_id", F.explode_outer("effects").alias("effect")).join(rules.withColumn("_k", rank).select("effect", "_k"), "effect", "left")
    worst = j.groupBy("call_id").agg(F.max(F.coalesce("_k", F.lit(1))).alias("_k"))
    return worst.select("call_id", F.when(F.col("_k") == 0, "allow").when((F.col("_k") == 1) & F.lit(interactive), "ask").otherwise("deny").alias("decision"))


def pinned_top(scored: DataFrame, pinned: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """by, item, score, rank: all ``pinned`` (by, item), then the best of ``scored`` (by, item, score) until there are k.

    Pinned items come whatever they score, by their score; others need a score over zero.  Scores are ranked once.
    """
    whole = Window.partitionBy(*by)
    both = scored.join(pinned.select(*by, item).distinct().withColumn("_p", F.lit(1)), [*by, item], "full").withColumn("_p", F.coalesce("_p", F.lit(0)))
    at = whole.orderBy(F.desc("_p"), F.desc_nulls_last("score"), F.asc(item))
    ranked = both.filter("_p = 1 OR score > 0").withColumn("rank", F.row_number().over(at)).withColumn("_n", F.sum("_p").over(whole))
    return ranked.filter(F.col("rank") <= F.greatest(F.col("_n"), F.lit(k))).select(*by, item, "score", "rank")


def allowed(tools: DataFrame, wanted: DataFrame, never: DataFrame) -> DataFrame:
    """agent, tool, error: the tools (tool) that an agent may have of those it wants (agent, tool), none of ``never`` (tool).

    An agent with none of them has one row with an error and no tool.
    """
    free = tools.select("tool").distinct().join(never.select("tool"), "tool", "left_anti")
    held = wanted.select("agent", "tool").distinct().join(free, "tool").select("agent", "tool", F.lit(None).cast("string").alias("error"))
    empty = wanted.select("agent").distinct().join(held.select("agent"), "agent", "left_anti")
    return held.unionByName(empty.select("agent", F.lit(None).cast("string").alias("tool"), F.lit("none of the wanted tools is available").alias("error")))


def verdicts(answers: DataFrame) -> DataFrame:
    """symbol_id, verified, agrees, verified_count, confidence, notes of a verifier's ``answers`` (symbol_id, failed, count, agrees, confidence, notes; all text but the first two).

    A failed call is not verified and says so.  A count that is no whole number is null, and then nothing agrees; a
    confidence is put between 0 and 1.
    """
    count = F.when(F.col("count").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("count")).try_cast("int")
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    bad = F.col("failed")
    return answers.select(
        "symbol_id", (~bad).alias("verified"), (~bad & count.isNotNull() & F.coalesce(F.col("agrees") == "true", F.lit(False))).alias("agrees"), F.when(~bad, count).alias("verified_count"),
        F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).alias("confidence"), F.when(bad, "verifier_error").otherwise(F.coalesce("notes", F.lit(""))).alias("notes"),
    )


def open_items(steps: DataFrame, conditions: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """plan_id, note of the plans that are not complete: a line for each step and condition still open, in order."""
    s = steps.filter(~F.col("status").isin(*terminal)).select("plan_id", F.lit(0).alias("o"), F.col("step").alias("i"), F.concat(F.lit("  - step not done: "), "description").alias("line"))
    c = conditions.filter("NOT satisfied").select("plan_id", F.lit(1).alias("o"), F.col("condition").alias("i"), F.concat(F.lit("  - postcondition not verified: "), "description").alias("line"))
    listed = s.unionByName(c).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("o", "i", "line"))).alias("_l"))
    return listed.select("plan_id", F.array_join(F.concat(F.array(F.lit("[stopped: plan not verified complete]")), F.transform("_l", lambda x: x["line"])), "\n").alias("note"))


# How a step's status is marked.
MARKS = {"pending": "[ ]", "in_progress": "[.]", "done": "[x]", "blocked": "[!]"}


def plan_text(plans: DataFrame, steps: DataFrame, conditions: DataFrame) -> DataFrame:
    """plan_id, text of every plan: its objective, its numbered steps and its conditions, each with its evidence."""
    mark = F.try_element_at(F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv)), F.col("status"))
    more = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n     {c}: "), c))
    line = lambda i, m, *rest: F.concat_ws("", F.concat(F.col(i).cast("string"), F.lit(". "), m, F.lit(" "), "description"), *rest)
    s = steps.select("plan_id", F.col("step").alias("i"), line("step", mark, more("evidence"), more("notes")).alias("line"))
    c = conditions.select("plan_id", F.col("condition").alias("i"), line("condition", F.when(F.col("satisfied"), "[x]").otherwise("[ ]"), more("evidence")).alias("line"))
    of = lambda df, name: df.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: F.concat(F.lit("\n"), x["line"])), "").alias(name))
    j = plans.join(of(s, "_s"), "plan_id", "left").join(of(c, "_c"), "plan_id", "left")
    return j.select("plan_id", F.concat(F.lit("# Plan: "), "objective", F.lit("\n\n## Steps"), F.coalesce("_s", F.lit("")), F.lit("\n\n## Postconditions"), F.coalesce("_c", F.lit(""))).alias("text"))


def decide_in_session(calls: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """call_id, decision, reason of calls (session, at, call_id, name, args, effects): what a user allowed once stays allowed in the session.

    ``answers`` (call_id, answer) is what the user says where a call is asked for; no answer is a denial.  A call is the
    same as an earlier one by its name and its arguments in canonical form (``args`` is a map).
    """
    asked = decide(calls, rules, True)
    key = F.struct("session", "name", F.array_sort(F.map_entries(F.coalesce("args", F.create_map().cast("map<string,string>")))).alias("args"))
    j = calls.select("session", "at", "call_id", key.alias("_k")).join(asked, "call_id").join(answers.select("call_id", "answer"), "call_id", "left")
    said = F.when((F.col("decision") == "ask") & (F.col("answer") == "allow"), F.col("at"))
    first = F.min(said).over(Window.partitionBy("_k"))
    before = first.isNotNull() & (F.col("at") > first)
    out = j.withColumn("_before", before)
    decision = F.when(F.col("_before"), "allow").when(F.col("decision") != "ask", F.col("decision")).otherwise(F.coalesce("answer", F.lit("deny")))
    reason = F.when(F.col("_before"), "approved before").when(F.col("decision") != "ask", "rule").when(F.col("answer").isNull(), "nobody to ask").otherwise("user")
    return out.select("call_id", decision.alias("decision"), reason.alias("reason"))


def assistant_blocks(responses: DataFrame) -> DataFrame:
    """conv_id, turn, block_ord, kind, text, call_id, name, args of assistant ``responses`` (conv_id, turn, text, reasoning, reasoning_tokens, calls).

    Reasoning comes first, where there is text or metadata of it; then all calls, or else the text.
    """
    block = lambda kind, text, call=None: F.struct(F.lit(kind).alias("kind"), text.alias("text"), *((F.lit(None) if call is None else call[c]).cast("string").alias(a) for c, a in (("id", "call_id"), ("name", "name"), ("args", "args"))))
    thought = F.array_compact(F.array(F.when(F.coalesce("reasoning", F.lit("")) != "", block("reasoning", F.col("reasoning")))))
    calls = F.transform(F.coalesce("calls", F.array().cast("array<struct<id:string,name:string,args:string>>")), lambda c: block("call", F.lit(None).cast("string"), c))
    said = F.when(F.size(calls) > 0, calls).otherwise(F.array(block("text", F.coalesce("text", F.lit("")))))
    return responses.select("conv_id", "turn", F.posexplode(F.concat(thought, said)).alias("block_ord", "_b")).select("conv_id", "turn", "block_ord", "_b.*")


def argument_errors(calls: DataFrame, required: DataFrame, most: int = 200) -> DataFrame:
    """call_id, error of ``calls`` (call_id, name, args) whose arguments are no JSON object, or lack what ``required`` (name, field) asks for.

    What could not be read is shown up to ``most`` characters; the two kinds of error stay apart.
    """
    # Within brackets nothing may follow the one value.
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), "args", F.lit("]"))) == 1, F.lit(False))
    fields = F.json_object_keys("args")
    shown = F.when(F.length("args") > most, F.concat(F.substring("args", 1, most), F.lit("…"))).otherwise(F.col("args"))
    bad = ~one | fields.isNull()
    asked = required.groupBy("name").agg(F.array_sort(F.collect_set("field")).alias("_f"))
    j = calls.join(asked, "name", "left").withColumn("_lost", F.array_except(F.coalesce("_f", F.array().cast("array<string>")), fields))
    error = F.when(bad, F.concat("name", F.lit(": arguments were not valid JSON: "), F.coalesce(shown, F.lit("")))).when(F.size("_lost") > 0, F.concat("name", F.lit(": invalid arguments, missing "), F.array_join("_lost", ", ")))
    return j.select("call_id", error.alias("error")).filter("error IS NOT NULL")
