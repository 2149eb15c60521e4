import re

from pyspark.sql import functions as F

from plumbline.functions import text as X


def test_short_tokens_and_anchor_hits(spark):
    """Counts over odd texts as by splitting into words; the text is not split, and its upper case taken once."""
    said = ["AB abc ABCDE A_B É ÉA A1 (XY) ZZZZ", "", "ABCD\nEF,GH", None, "a" * 50 + " Q", "Section SECTION sections door schedule", "𝒳AB AB𝒳 AB", "room finish schedule"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", X.short_tokens(F.col("t")).alias("n"), X.anchor_hits(F.col("t")).alias("h"))
    got = {r.i: (r.n, r.h) for r in df.collect()}
    for i, t in enumerate(said):
        if t is None:
            continue
        words = re.split(r"[^\w]+", t)
        assert got[i] == (sum(bool(re.fullmatch("[A-Z]{1,4}", w)) for w in words), {a: t.upper().count(a) for a in X.ANCHORS if a in t.upper()}), t
    assert got[3] == (None, None)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("upper(") == 1
