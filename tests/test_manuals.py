"""Bid items, contents, section starts and abbreviations on literal texts."""

import random

from plumbline.operators import manuals as M

ALTERNATES = """SCHEDULE
1.
Alternate No. 7: Green Roof over the Lobby.
a.
Base Bid: Gravel roof with   two drains.
b.
Deductive Alternate: No roof at all.
2.
Alternate No. 9: Night Work.
a.
Base Bid: Work between seven and five.
b.
Deductive Alternate: Work on Sundays.
"""
PRICES = """1.
Unit Price No. 4: Rock Removal
Description: Drill and blast.
Unit of Measurement: Cubic yard.
2.
Unit Price No. 5: Extra Conduit
Unit of Measurement: Linear foot.
"""


def test_bid_items(spark):
    df = spark.createDataFrame([(1, ALTERNATES), (2, None), (3, "")], "id int, text string")
    got = [tuple(r) for r in M.bid_items(df, "alternate", ["id"]).orderBy("ordinal").collect()]
    assert [(r[2], r[3], r[4]) for r in got] == [("7", "Green Roof over the Lobby", "deduct"), ("9", "Night Work", "deduct")] and got[0][5] == "Gravel roof with two drains."
    got = [tuple(r) for r in M.bid_items(spark.createDataFrame([(1, PRICES)], "id int, text string"), "unit_price", ["id"]).orderBy("ordinal").collect()]
    assert [r[2:] for r in got] == [("4", "Rock Removal", "unit", "Drill and blast.", "Cubic yard"), ("5", "Extra Conduit", "unit", "", "Linear foot")]
    add = spark.createDataFrame([(1, "Alternate No 3: X\nAdditive Alternate: y\nAlternate No. 4: Z\n")], "id int, text string")
    assert [r.basis for r in M.bid_items(add, "alternate", ["id"]).orderBy("ordinal").collect()] == ["add", "unknown"]


def test_toc(spark):
    text = ["ACME 12", "DIVISION 00 - PROCUREMENT", "Form of bid", "DIVISION 04 - MASONRY", "NOT APPLICABLE", "DIVISION 08 – OPENINGS", "SECTION 081113 - HOLLOW METAL DOORS AND", "FRAMES", "08 14 16 FLUSH WOOD-", "DOORS", "1 May 2024"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(text)], "file string, n int, line string")
    divisions, sections = M.toc(df, ["file"], ["n"], firm="ACME")
    assert [(r.division, r.title, r.applicable) for r in divisions.orderBy("ord").collect()] == [("00", "PROCUREMENT", True), ("04", "MASONRY", False), ("08", "OPENINGS", True)]
    assert [(r.division, r.section, r.title) for r in sections.orderBy("ord").collect()] == [("08", "081113", "HOLLOW METAL DOORS AND FRAMES"), ("08", "081416", "FLUSH WOOD-DOORS")]
    pages = spark.createDataFrame([("f", 0, "x"), ("f", 1, "a\nDIVISION 01 - A"), ("f", 2, "END OF TABLE OF CONTENTS"), ("f", 3, "x"), ("f", 4, "DIVISION 02 - B"), ("g", 0, None)], "file string, page_index int, text string")
    assert sorted(r.page_index for r in M.toc_pages(pages, ["file"]).collect()) == [1, 2]


def test_section_starts(spark):
    rows = [("f", 1, "TABLE OF CONTENTS\nSECTION 012300 - ALTERNATES"), ("f", 5, "\n\nSECTION 012300 – ALTERNATES\nx"), ("f", 6, "SECTION 012300 - ALTERNATES"), ("f", 7, "a\n" * 9 + "SECTION 099999 - LOW")]
    got = M.section_starts(spark.createDataFrame(rows, "file string, page_index int, text string"), ["file"]).collect()
    assert [tuple(r) for r in got] == [("f", "012300", 5)]


def test_clustering_is_anchored(spark):
    rng = random.Random(4)
    tops = [(i, rng.randrange(0, 80) / 2) for i in range(60)]
    want, ref, n = {}, None, -1
    for i, t in sorted(tops, key=lambda x: (x[1], x[0])):
        if ref is None or abs(t - ref) > 5:
            ref, n = t, n + 1
        want[i] = n
    got = M.clustered_rows(spark.createDataFrame([("p", i, t) for i, t in tops], "page string, pos int, top double"), ["page"])
    assert {r.pos: r.row for r in got.collect()} == want


def test_abbreviations(spark):
    rows = [(0, "AACC", 170.0, 10.0), (1, "ACOUSTIC", 200.0, 11.0), (2, "CEILING", 260.0, 9.0), (3, "HM", 441.0, 10.0), (4, "HOLLOW", 470.0, 10.0), (5, "lone", 713.0, 10.0), (6, "HM", 441.0, 30.0), (7, "HOLLOW", 470.0, 30.0), (8, "far", 10.0, 30.0)]
    got = M.abbreviations(spark.createDataFrame([("p", *r) for r in rows], "page string, pos int, text string, x0 double, top double"), ["page"]).orderBy("ord").collect()
    assert [(r.abbreviation, r.definition) for r in got] == [("AC", "ACOUSTIC CEILING"), ("HM", "HOLLOW")]
