"""Literal vectors for operators and functions, and comparisons with plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import joins, ordered
from plumbline.operators import schema_resolver as R
from plumbline.plans import service
from plumbline.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def windows(spark, pages, high, cap, low=0):
    df = spark.createDataFrame([(p,) for p in pages], "p int")
    return sorted(tuple(r) for r in ordered.windows(df, "p", low, high, cap).collect())


def test_windows(spark):
    assert windows(spark, [], 133, 30) == [(0, 0, 133, 0)]
    assert windows(spark, range(0, 40, 2), 133, 30) == [(0, 0, 133, 20)]
    assert windows(spark, [1, 2, 3, 4, 5], 10, 2) == [(0, 0, 3, 2), (1, 3, 5, 2), (2, 5, 10, 1)]
    assert windows(spark, [0, 1, 2, 3], 4, 2) == [(0, 0, 2, 2), (1, 2, 4, 2)]
    assert windows(spark, [3, 3, 3, -1, 999], 10, 30) == [(0, 0, 10, 1)] and windows(spark, [], 0, 30) == []
    got = windows(spark, range(5, 79), 133, 30)
    assert len(got) == 3 and sum(w[3] for w in got) == 74 and got[0][1] == 0 and got[-1][2] == 133
    got = windows(spark, range(0, 100, 5), 90, 4, 40)
    assert got[0][1] == 40 and got[-1][2] == 90 and all(w[3] <= 4 for w in got)
    with pytest.raises(ValueError):
        windows(spark, [1], 10, 0)


def test_absorb_equals_loop(spark):
    def loop(kinds, least):
        kinds = list(kinds)
        changed = True
        while changed:
            changed, runs, i = False, [], 0
            while i < len(kinds):
                j = i
                while j < len(kinds) and kinds[j] == kinds[i]:
                    j += 1
                runs.append((i, j))
                i = j
            for (a, b), left, right in zip(runs[1:-1], runs, runs[2:], strict=False):
                if b - a < least and kinds[left[0]] == kinds[right[0]] != kinds[a]:
                    kinds[a:b] = [kinds[left[0]]] * (b - a)
                    changed = True
                    break
        return kinds

    rng = random.Random(1)
    cases = [[rng.choice("ab") if rng.random() < 0.5 else "a" for _ in range(rng.randrange(1, 25))] for _ in range(120)]
    df = spark.createDataFrame([(i, p, k) for i, c in enumerate(cases) for p, k in enumerate(c)], "f int, p int, kind string")
    got = {}
    for r in ordered.regions(df, ["f"], "p", "kind", 3).collect():
        got.setdefault(r.f, {}).update({p: r.kind for p in range(r.page_start, r.page_end + 1)})
    assert all([got[i][p] for p in range(len(c))] == loop(c, 3) for i, c in enumerate(cases))


def test_nearest(spark):
    def run(rooms, labels):
        a = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(labels)], "page int, label_ord int, x double, y double")
        b = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(rooms)], "page int, room_ord int, x double, y double")
        return sorted((r.room_ord, r.label_ord, r.distance) for r in joins.nearest_within(a, b, ["page"], 100.0).collect())

    assert run([(0, 0), (1000, 0)], [(10, 0), (1500, 0)]) == [(0, 0, 10.0)]
    assert run([(0, 0), (60, 0)], [(10, 0)]) == [(0, 0, 10.0)]
    rng = random.Random(2)
    rooms, labels = ([(rng.randrange(0, 400, 20), rng.randrange(0, 400, 20)) for _ in range(25)] for _ in range(2))
    bound = {}
    for n, p in enumerate(labels):
        d, r = min((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5, i) for i, q in enumerate(rooms))
        if d <= 100:
            bound.setdefault(r, []).append((d, n))
    assert [(r, n) for r, n, _ in run(rooms, labels)] == sorted((r, min(v)[1]) for r, v in bound.items())


def test_merge_verdicts(spark):
    counts = spark.createDataFrame([("WC-1", 3, 0.7), ("L-2", 15, 0.7), ("X", 1, 0.7)], "symbol_id string, count int, confidence double")
    verdicts = spark.createDataFrame([("WC-1", True, True, 0.9), ("L-2", True, False, 0.6), ("X", False, None, None)], "symbol_id string, verified boolean, agrees boolean, confidence double")
    got = {r.symbol_id: (r["count"], r.confidence, r.verified) for r in joins.merge_verdicts(counts, verdicts, ["symbol_id"]).collect()}
    assert got == {"WC-1": (3, 0.9, True), "L-2": (15, 0.3, True), "X": (1, 0.7, False)}


def test_flip(spark):
    items = spark.createDataFrame([("WC-1", None, None, "unknown_plan_count"), ("L-9", None, None, "unknown_plan_count")], "mark string, quantity double, unit string, quantity_basis string")
    counts = spark.createDataFrame([("WC-1", 3, True), ("L-9", 2, False)], "symbol_id string, building_total int, verified boolean")
    got = {tuple(r) for r in joins.flip(items, counts).collect()}
    assert got == {("WC-1", 3.0, "EA", "plan_count"), ("L-9", None, None, "unknown_plan_count")}


@pytest.mark.parametrize(("said", "factor"), [("1/8\" = 1'", 96), ("3/64\" = 1'", 256), ("1/4\" = 1'", 48), ("1/2\" = 1'", 24), ("3/4\" = 1'", 16), ("1\" = 20'", 240), ("none", None)])
def test_scale(spark, said, factor):
    assert one(spark, said, X.scale_factor) == factor


def test_small_functions(spark):
    assert one(spark, "FIRE RATING (MINUTES)", X.normalize) == "fire rating minutes" and one(spark, None, X.normalize) == ""
    assert [one(spark, s, X.number) for s in ("22.32", "12 EA", "n/a")] == [22.32, 12.0, None]
    assert one(spark, "AADDDDIITTIIOONNAALL", X.dedouble) == "ADDITIONAL" and one(spark, "HM", X.dedouble) == "HM"
    assert all(one(spark, s, X.looks_like_tag) for s in ("A", "WC-1", "L1", "GPO-2", "W12")) and not any(one(spark, s, X.looks_like_tag) for s in ("TYPE", "NAME", "NORTH - EAST", ""))
    assert [one(spark, s, X.token_kind) for s in ("S-3", "N107B", "266' - 0\"", "A9.3.1", " ")] == ["grid_label", "door_mark", "dimension", "sheet_reference", "blank"]
    assert one(spark, "a SECTION and section", lambda c: X.anchor_hits(c)) == {"SECTION": 2}


def cells(spark, grid):
    return spark.createDataFrame([("t", r, c, x) for r, row in enumerate(grid) for c, x in enumerate(row)], "table string, row_ord int, col_ord int, text string")


DOOR_GRID = [
    ["DOOR AND INTERIOR OPENING SCHEDULE"] + [""] * 13,
    ["NUMBER", "FIRE RATING (MINUTES)", "SIZE", "", "DOOR", "", "", "FRAME", "", "", "HARDWARE SET", "GLASS FILM", "GLASS TYPE", "SPECIAL NOTES AND COMMENTS"],
    ["", None, "WIDTH", "HEIGHT", "ELEVATION", "MATERIAL", "FINISH", "ELEVATION", "MATERIAL", "FINISH", "", "", "", ""],
    ["N107B", "", "6' - 0\"", "7' - 0\"", "F", "WD", "WV-1", "A", "HM", "P-1C", "205", "N/A", "N/A", ""],
]


def test_resolver(spark):
    mapping, tables = R.resolve(cells(spark, DOOR_GRID), R.DOOR, ["table"])
    got = {r.col_ord: r.field for r in mapping.collect()}
    want = "door_mark fire_rating_minutes width height door_elevation_type door_material door_finish frame_elevation_type frame_material frame_finish hardware_set glass_film glass_type special_notes".split()
    assert got == dict(enumerate(want)) and tuple(tables.first()) == ("t", 3, 1.0)
    item = R.table_items(cells(spark, DOOR_GRID).withColumn("kind", F.lit("door")), ["table"]).first()
    assert (item.mark, item.quantity, item.quantity_basis, item.attributes["frame_material"]) == ("N107B", 1.0, "row_count", "HM")
    finish = [["ROOM FINISH SCHEDULE"] + [""] * 6, ["NUMBER", "NAME", "FLOOR", "BASE", "WALL", "CEILING", "COMMENTS"], ["N105", "LAB", "RF", "RB", "P", "ACT", ""]]
    assert [r.field for r in R.resolve(cells(spark, finish), R.FINISH, ["table"])[0].orderBy("col_ord").collect()] == ["room_number", "room_name", "floor_finish", "base_finish", "wall_finish", "ceiling_finish", "comments"]
    none = R.resolve(cells(spark, [["x", "y"], ["1", "2"]]), R.DOOR, ["table"])
    assert none[0].count() == 0 and tuple(none[1].first()) == ("t", 0, 0.0)


def test_catalog_quantity(spark):
    grid = [["TAG", "DESCRIPTION", "QTY"], ["WC-1", "closet", "4"], ["L-1", "lavatory", "n/a"]]
    got = {r.mark: (r.quantity, r.quantity_basis) for r in R.table_items(cells(spark, grid).withColumn("kind", F.lit("plumbing_fixture")), ["table"]).collect()}
    assert got == {"WC-1": (4.0, "qty_column"), "L-1": (None, "unknown_plan_count")}


def test_expand_merged(spark):
    df = spark.createDataFrame([("N1 N2", "3' 4'", "WD")], "mark string, width string, material string")
    assert sorted(tuple(r) for r in R.expand_merged(df, "mark", ["width", "material"]).select("mark", "width", "material").collect()) == [("N1", "3'", "WD"), ("N2", "4'", "")]


def test_first_wins_over_shards(spark):
    """Serial and sharded results agree for any cuts."""
    rng = random.Random(3)
    rows = [(i, rng.choice("abcdefgh")) for i in range(60)]
    cuts = sorted(rng.sample(range(60), 3))
    df = spark.createDataFrame([(i, sum(i >= c for c in cuts), m) for i, m in rows], "ord int, shard int, mark string")
    serial = {(r.mark, r.ord) for r in ordered.first_wins(df, ["mark"], [F.col("ord")]).collect()}
    parts = ordered.first_wins(df, ["shard", "mark"], [F.col("ord")])
    assert serial == {(r.mark, r.ord) for r in ordered.first_wins(parts, ["mark"], [F.col("shard"), F.col("ord")]).collect()}


def test_pages_and_filters(spark):
    df = spark.range(23).withColumn("k", F.col("id") % 2)
    assert [r.id for r in ordered.page_of(df, ["id"], 3, 10).collect()] == [20, 21, 22] and service.filtered(df, {"k": None}, {"id": None}).count() == 23
    for bad in ((0, 10), (1, 0), (1, 501)):
        with pytest.raises(ValueError):
            ordered.page_of(df, ["id"], *bad)


def test_accumulate(spark):
    rows = [("r", 0, "text", None, None, "he", None), ("r", 1, "tool_start", "a", "f", None, '{"x"'), ("r", 2, "tool_delta", None, None, None, ":1}"), ("r", 3, "text", None, None, "y", None), ("r", 4, "tool_start", "b", "g", None, "{bad"), ("o", 0, "tool_delta", None, None, None, "1")]
    df = spark.createDataFrame(rows, "response_id string, seq int, kind string, id string, name string, text string, args_fragment string")
    got = {r.response_id: (r.text, [(c.id, c.name, c.args) for c in r.calls]) for r in ingest.accumulate(df).collect()}
    assert got == {"r": ("hey", [("a", "f", '{"x":1}'), ("b", "g", None)]), "o": ("", [("orphan", None, "1")])}


def test_stream_dedup(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    from datetime import datetime

    rows = [(i % 5, datetime(2024, 1, 1, 0, i), 1, "x", 1.0) for i in range(10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.unique_events(ingest.events_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
    assert ingest.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).count() == 5
