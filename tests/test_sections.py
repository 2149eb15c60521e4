"""Sections, waves and the ledger on small rows."""

from pyspark.sql import functions as F

from plumbline.operators import ledger, ordered, sections, waves

TITLES = [("081113", "HOLLOW METAL DOORS AND FRAMES"), ("081416", "FLUSH WOOD DOORS"), ("096813", "TILE CARPETING"), ("099123", "INTERIOR PAINTING"), ("084113", "ALUMINUM-FRAMED ENTRANCES")]


def links(spark, codes, seed, division=None):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = sections.section_map(frame(codes, "code string, expansion string"), frame(TITLES, "section string, title string"), frame(seed, "code string, section string"), division)
    return {r.code: (r.section, r.method, r.confidence, r.suggestion, r.disputed) for r in out.collect()}


def test_section_map(spark):
    codes = [("HM", "HOLLOW METAL"), ("CPT", "18 X 36 CARPET TILE"), ("GYP", "GYPSUM BOARD"), ("P", "GENERAL PAINT"), ("E", ""), ("AL", "ALUMINUM")]
    got = links(spark, codes, [("CPT", "096813"), ("GYP", "092900"), ("P", "096813")])
    assert got["HM"] == ("081113", "derived_lexical", 1.0, None, False)
    assert got["CPT"] == ("096813", "derived_lexical", 0.5, None, False)
    assert got["GYP"] == ("092900", "override", 0.0, None, False)
    assert got["P"] == ("096813", "override", 0.5, "099123", True)
    assert got["E"] == (None, "unresolved", 0.0, None, False)
    assert links(spark, codes, [], "08")["P"] == (None, "unresolved", 0.0, None, False)


def test_section_texts(spark):
    head = lambda n: f"\n\nSECTION {n} - A\n"
    pages = [(1, 0, "TABLE OF CONTENTS\nSECTION 012300 - A"), (1, 1, head("012300")), (1, 2, "more"), (1, 3, head("012300")), (1, 4, head("012600")), (1, 5, None), *((1, p, "x") for p in range(6, 14)), (2, 0, "none")]
    got = {(r.file, r.section): (r.start, r.pages, r.body) for r in sections.section_texts(spark.createDataFrame(pages, "file long, page long, text string"), ["file"]).collect()}
    assert got == {(1, "012300"): (1, 3, f"{head('012300')}\nmore\n{head('012300')}"), (1, "012600"): (4, 6, head("012600") + "\n\nx\nx\nx\nx")}


def test_products(spark):
    body = "Intro: Not listed; X Co\n  a. Ceco Door; ASSA ABLOY.\n2) Curries..; Ceco Door\nb. Comply with requirements; Meets Requirements of all\nabc. No\nc. A; " + "L" * 61
    df = spark.createDataFrame([("MANUFACTURERS", body), ("SUBMITTALS", body), ("MANUFACTURERS", None)], "title string, body string")
    assert [r[0] for r in df.select(sections.products(F.col("title"), F.col("body"))).collect()] == [["Ceco Door", "ASSA ABLOY", "Curries"], [], None]


def test_waves_do_not_depend_on_the_cap(spark):
    items = spark.createDataFrame([(p, r, s, m) for p, r, s, m in [(1, 0, "finish", "N101"), (1, 1, "finish", "N102"), (5, 0, "finish", "N101"), (5, 1, "door", "N103"), (9, 0, "finish", "N104"), (9, 1, "finish", "N104")]], "page long, row_ord long, schedule string, mark string")
    place = [(20, 0, "N101", 0, 0), (20, 1, "N102", 50, 0), (20, 2, "N104", 500, 0), (20, 3, "100SF", 5, 0), (20, 4, "200SF", 8, 0), (20, 5, "30000SF", 52, 0), (20, 6, "300SF", 700, 0), (21, 0, "N101", 0, 0), (21, 1, "N102", 9, 9), (21, 2, "N104", 30, 0), (21, 3, "1SF", 0, 0), (21, 4, "2SF", 31, 0), (21, 5, "3SF", 9, 10), (22, 0, "N103", 0, 0)]
    words = spark.createDataFrame([(a, b, c, float(d), float(e)) for a, b, c, d, e in place], "page long, pos long, text string, x double, y double")
    for cap in (1, 2, 50):
        merged, areas = waves.two_waves(items, words, ordered.windows(items, "page", 0, 30, cap))
        assert sorted((r.schedule, r.mark, r.page, r.row_ord) for r in merged.collect()) == [("door", "N103", 5, 1), ("finish", "N101", 1, 0), ("finish", "N102", 1, 1), ("finish", "N104", 9, 0)]
        assert sorted((r.room_number, r.area, r.confidence, r.page) for r in areas.collect()) == [("N101", 100.0, 0.95, 20), ("N102", 3.0, 0.99, 21), ("N104", 2.0, 0.99, 21)]


def test_ledger(spark):
    pages = spark.createDataFrame([(1, "7"), (2, "x"), (3, None), (4, "")], "page long, text string")
    load = F.when(F.col("text").isNull(), "unreadable")
    operations = [ledger.Operation("number", F.col("text").try_cast("int"), F.concat(F.lit("no number: "), "text")), ledger.Operation("word", F.nullif("text", F.lit("")), F.lit(None).cast("string"))]
    values, lost = ledger.attempted(pages, ["page"], load, operations)
    assert sorted(map(tuple, lost.collect())) == [(2, "number", "no number: x"), (3, "load", "unreadable"), (4, "number", "no number: ")]
    assert sorted(map(tuple, values.collect()), key=repr) == [(1, "number", "7"), (1, "word", "7"), (2, "word", "x"), (4, "word", None)]
    assert sorted(r.page for r in ledger.window(pages, "page", 2, 4).collect()) == [2, 3] and ledger.window(pages, "page").count() == 4
