"""Sheets and transcripts on literal rows."""

from pyspark.sql import functions as F

from plumbline.operators import sheets as S
from plumbline.operators import transcripts as T


def words(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "page string, pos int, text string, x double, y double")


def test_area_labels(spark):
    w = words(spark, [("816", 1.0, 1.0), ("SF", 2.0, 1.0), ("1,024S.F.", 5.0, 5.0), ("12", 0.0, 0.0), ("EA", 0.0, 0.0)])
    assert [(r.area, r.x) for r in S.area_labels(w, ["page"]).orderBy("pos").collect()] == [(816.0, 1.0), (1024.0, 5.0)]


def test_fixture_counts(spark):
    pages = spark.createDataFrame([("p", 3024.0, 2160.0)], "page string, width double, height double")
    tags = spark.createDataFrame([("WC-1",)], "tag string")
    run = lambda pts: S.fixture_counts(words(spark, [("WC-1", float(x), float(y)) for x, y in pts]), tags, pages, ["page"]).collect()
    assert run([(300, 300), (2100, 1900), (1200, 1000)])[0]["count"] == 3 and run([(850, 1050), (860, 1200), (1000, 1400)]) == [] and run([(1, 1)]) == []


def test_scales(spark):
    df = spark.createDataFrame([("a", 0, "1/8\" = 1'-0\" x 1/8\"=1'"), ("b", 0, "1/4\" = 1'"), ("b", 1, "1\" = 20'"), ("c", 0, "none")], "sheet string, ord int, text string")
    got = {r.sheet: (r.factor, r.confidence, r.ambiguous) for r in S.sheet_scales(df, ["sheet"], "ord").collect()}
    assert got == {"a": (96.0, 1.0, False), "b": (48.0, 0.4, True), "c": (None, 0.0, False)}


def test_title_block(spark):
    rows = [("s", 0, "A2.1", 10.0, 500.0, 540.0), ("s", 1, "FLOOR", 10.0, 470.0, 485.0), ("s", 2, "PLAN", 60.0, 471.0, 486.0), ("s", 3, "FAR", 10.0, 300.0, 310.0)]
    got = S.title_blocks(spark.createDataFrame(rows, "page string, pos int, text string, x0 double, top double, bottom double"), ["page"]).first()
    assert (got.sheet_number, got.title) == ("A2.1", "FLOOR PLAN")


def test_geometry(spark):
    rows = [("p", "line", 0.0, 0.0, 90.0, 0.0), ("p", "line", 0.0, 0.0, 3.0, 3.0), ("p", "rect", 1.0, 1.0, 99.0, 99.0)]
    g = S.geometry(spark.createDataFrame(rows, "page string, kind string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([("p", 100.0, 100.0)], "page string, width double, height double"), ["page"]).first()
    assert (g.lines, g.rects, g.long_lines, g.axis_lines, g.border) == (2, 1, 1, 1, True)


def blocks(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "conv_id int, turn int, block_ord int, role string, kind string, text string, call_id string, name string, args string")


def test_transcripts(spark):
    b = blocks(spark, [(0, 0, "user", "text", "start here", None, None, None), (1, 0, "assistant", "call", None, "A", "f", "{}"), (2, 0, "tool", "result", "one two three four five", "A", None, None), (3, 0, "assistant", "call", None, "B", "f", "{}"), (4, 0, "tool", "result", "six", "B", None, None), (5, 0, "tool", "result", "lost", "GONE", None, None), (6, 0, "assistant", "call", None, "C", "f", "{}"), (7, 0, "assistant", "text", "done", None, None, None)])
    clean = T.without_orphans(b)
    assert clean.count() == 7 and T.without_orphans(clean).count() == 7
    m = T.masked(clean, 1, "[old]").filter("kind = 'result'").orderBy("turn").collect()
    assert [(r.text, r.freed) for r in m] == [("[old]", 4), ("six", 0)]
    assert [r.name for r in T.loops(b).collect()] == ["f"] and T.last_text(b).first().text == "done"
    assert T.query_text(b.filter("kind = 'text'")).first().query == "start here done"


def test_plan_and_permissions(spark):
    steps = spark.createDataFrame([(1, "a", "done"), (1, "b", "blocked"), (2, "a", "open")], "plan_id int, step string, status string")
    conditions = spark.createDataFrame([(1, True)], "plan_id int, satisfied boolean")
    assert {r.plan_id: (r.ready, r.open) for r in T.plan_ready(steps, conditions).collect()} == {1: (True, []), 2: (False, ["a"])}
    calls = spark.createDataFrame([("x", ["read"]), ("y", ["read", "write"]), ("z", [])], "call_id string, effects array<string>")
    rules = spark.createDataFrame([("read", "allow"), ("write", "ask")], "effect string, decision string")
    assert {r.call_id: r.decision for r in T.decide(calls, rules).collect()} == {"x": "allow", "y": "deny", "z": "deny"}
    assert {r.call_id: r.decision for r in T.decide(calls, rules, True).collect()} == {"x": "allow", "y": "ask", "z": "ask"}
