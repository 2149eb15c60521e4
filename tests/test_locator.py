"""The locator on small packages: statuses, the pages of a run, decisive tables, and late reading of tables."""

import pytest

from plumbline.operators import locator

PROFILE = "package long, file_id long, page_index long, anchor_hits map<string,int>, short_token_count int"
TOC = "DIVISION 08 - OPENINGS\n081113 - HOLLOW METAL DOORS\nSECTION 096813 - TILE CARPETING"
WIDE = ["MARK", "WIDTH", "HEIGHT", "DOOR MATERIAL", "HARDWARE SET", "NOTES"]


def located(spark, pages, regions, tables):
    """pages: (file, page, anchors, short tokens, text); tables: (file, page, table, rows)."""
    profiles = spark.createDataFrame([(1, f, p, {a: 1 for a in hits}, n) for f, p, hits, n, _ in pages], PROFILE)
    texts = spark.createDataFrame([(1, f, p, t) for f, p, *_, t in pages], "package long, file_id long, page_index long, text string")
    cells = [(1, f, p, t, r, c, x) for f, p, t, rows in tables for r, row in enumerate(rows) for c, x in enumerate(row)]
    cells = spark.createDataFrame(cells, "package long, file_id long, page_index long, table_ord int, row_ord int, col_ord int, text string")
    where = spark.createDataFrame([(1, *r) for r in regions], "package long, file_id long, kind string, page_start long, page_end long")
    out = locator.locate(profiles.select("package").distinct(), profiles, where, texts, cells)
    return {r.artifact: (r.status, r.confidence, [(p.file_id, p.page_index) for p in r.pages or []]) for r in out.collect()}


def test_statuses(spark):
    pages = [(1, p, ["TABLE OF CONTENTS"], 0, TOC if p != 3 else "DIVISION 08 - A") for p in (1, 3, 4, 5)]
    pages += [(2, p, ["DOOR SCHEDULE", "FIRE RATING"], 0, "") for p in (7, 8, 10)] + [(2, 9, ["DOOR SCHEDULE"], 0, "")]
    pages += [(2, 20, ["ABBREVIATION"], 100, ""), (2, 21, ["ABBREVIATION"], 300, ""), (2, 30, ["FINISH SCHEDULE"], 0, ""), (1, 40, ["SHEET NUMBER", "SHEET NAME"], 0, "")]
    # Page 8 has a narrow table and one of three core fields in four; the finish table has six columns.
    tables = [(2, 7, 0, [WIDE]), (2, 8, 0, [WIDE[:5]]), (2, 8, 1, [["MARK", "WIDTH", "HEIGHT", "COLOUR", "HARDWARE SET", "X"]]), (2, 9, 0, [WIDE]), (2, 10, 0, [WIDE])]
    tables += [(2, 30, 0, [["FLOOR", "BASE", "WALL", "CEILING", "", ""]]), (1, 40, 0, [["SHEET NUMBER", "NAME"]])]
    got = located(spark, pages, [(1, "manual", 0, 50), (2, "drawings", 0, 50)], tables)
    assert got["spec_toc"] == ("found", 1.0, [(1, 4), (1, 5)])
    assert got["door_schedule"] == ("found", 1.0, [(2, 7), (2, 8)])
    assert got["abbreviations"] == ("low_confidence", 0.429, [(2, 21)])
    assert got["finish_schedule"] == ("absent", None, [])
    assert got["drawing_index"] == ("absent", None, [])


def test_status_is_that_of_the_run(spark):
    """A longer run of pages that are less sure wins; the surer page elsewhere does not count."""
    pages = [(2, p, ["FINISH SCHEDULE"], 0, "") for p in (1, 2, 9)]
    four = [["FLOOR", "BASE", "WALL", "CEILING", "", "", ""]]
    title = [["ROOM FINISH SCHEDULE", "", "", "", "", "", ""]]
    got = located(spark, pages, [(2, "drawings", 0, 9)], [(2, 1, 0, four), (2, 1, 1, title), (2, 2, 0, four), (2, 9, 0, title)])
    assert got["finish_schedule"] == ("found", 0.7, [(2, 1), (2, 2)])
    assert got["spec_toc"] == ("not_applicable", None, [])


def test_front_matter(spark):
    regions = spark.createDataFrame([(1, "manual", 0, 1, 2), (1, "drawings", 2, 9, 8), (1, "manual", 10, 11, 2), (2, "manual", 0, 1, 2), (3, "manual", 0, 5, 6)], "file_id long, kind string, page_start long, page_end long, pages long")
    profiles = spark.createDataFrame([(1, 0, {"DOOR SCHEDULE": 1}), (1, 11, {"DIVISION": 2}), (2, 0, {})], "file_id long, page_index long, anchor_hits map<string,int>")
    got = {(r.file_id, r.page_start): r.kind for r in locator.front_matter(regions, profiles).collect()}
    assert got == {(1, 0): "front_matter", (1, 2): "drawings", (1, 10): "manual", (2, 0): "front_matter", (3, 0): "manual"}


@pytest.mark.parametrize("name", ["spec_toc", "drawing_index"])
def test_fits(spark, name):
    spec = next(s for s in locator.SPECS if s.name == name)
    df = spark.createDataFrame([({a: 1 for a in spec.anchors},), ({"SHEET NAME": 1},), ({},)], "h map<string,int>")
    assert [r[0] for r in df.select(spec.fits(df.h)).collect()] == [True, False, False]
