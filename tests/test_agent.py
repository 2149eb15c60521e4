"""Pinning, allow-lists, verdicts, plans and sessions on literal rows."""

from plumbline.operators import transcripts as T


def test_pinned_top(spark):
    scored = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (1, "z", 0.0), (2, "a", 1.0)], "q long, tool string, score double")
    pinned = spark.createDataFrame([(1, "c"), (1, "x"), (1, "c"), (3, "p"), (3, "r"), (3, "s"), (3, "t")], "q long, tool string")
    got = sorted(T.pinned_top(scored, pinned, ["q"], "tool", 3).select("q", "rank", "tool").collect())
    assert [tuple(r) for r in got] == [(1, 1, "c"), (1, 2, "x"), (1, 3, "a"), (2, 1, "a"), (3, 1, "p"), (3, 2, "r"), (3, 3, "s"), (3, 4, "t")]


def test_allowed(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    out = T.allowed(frame([("read",), ("spawn",), ("count",)], "tool string"), frame([("x", "read"), ("x", "spawn"), ("x", "no"), ("y", "spawn")], "agent string, tool string"), frame([("spawn",)], "tool string"))
    assert sorted(map(tuple, out.collect()), key=repr) == [("x", "read", None), ("y", None, "none of the wanted tools is available")]


def test_verdicts(spark):
    rows = [("a", False, "3", "true", "1.7", None), ("b", False, "x", "true", "0.5", "n"), ("c", True, "3", "true", "0.5", "n"), ("d", False, " -2 ", None, None, "n"), ("e", False, None, "true", "nan?", "")]
    got = {r[0]: tuple(r)[1:] for r in T.verdicts(spark.createDataFrame(rows, "symbol_id string, failed boolean, count string, agrees string, confidence string, notes string")).collect()}
    assert got == {"a": (True, True, 3, 1.0, ""), "b": (True, False, None, 0.5, "n"), "c": (False, False, None, 0.0, "verifier_error"), "d": (True, False, -2, 0.0, "n"), "e": (True, False, None, 0.0, "")}


def test_plans(spark):
    plans = spark.createDataFrame([(1, "Count"), (2, "Rest")], "plan_id long, objective string")
    steps = spark.createDataFrame([(1, 2, "check", "pending", None, "soon"), (1, 1, "read", "done", "p. 3", None)], "plan_id long, step long, description string, status string, evidence string, notes string")
    conditions = spark.createDataFrame([(1, 1, "all rooms", False, None), (2, 1, "none", True, "e")], "plan_id long, condition long, description string, satisfied boolean, evidence string")
    text = {r.plan_id: r.text for r in T.plan_text(plans, steps, conditions).collect()}
    assert text[1] == "# Plan: Count\n\n## Steps\n1. [x] read\n     evidence: p. 3\n2. [ ] check\n     notes: soon\n\n## Postconditions\n1. [ ] all rooms"
    assert text[2] == "# Plan: Rest\n\n## Steps\n\n## Postconditions\n1. [x] none\n     evidence: e"
    assert [tuple(r) for r in T.open_items(steps, conditions).collect()] == [(1, "[stopped: plan not verified complete]\n  - step not done: check\n  - postcondition not verified: all rooms")]


def test_sessions(spark):
    calls = spark.createDataFrame([(1, 1, "a", "write", {"p": "1", "q": "2"}, ["write"]), (1, 2, "b", "write", {"q": "2", "p": "1"}, ["write"]), (1, 3, "c", "write", {"p": "2"}, ["write"]), (2, 4, "d", "write", {"p": "1", "q": "2"}, ["write"]), (1, 5, "e", "read", None, ["read"]), (1, 6, "f", "rm", None, ["rm", "read"])], "session long, at long, call_id string, name string, args map<string,string>, effects array<string>")
    rules = spark.createDataFrame([("read", "allow"), ("write", "ask"), ("rm", "deny")], "effect string, decision string")
    answers = spark.createDataFrame([("a", "allow"), ("c", "deny")], "call_id string, answer string")
    got = {r.call_id: (r.decision, r.reason) for r in T.decide_in_session(calls, rules, answers).collect()}
    assert got == {"a": ("allow", "user"), "b": ("allow", "approved before"), "c": ("deny", "user"), "d": ("deny", "nobody to ask"), "e": ("allow", "rule"), "f": ("deny", "rule")}
