from plumbline.operators import joins


def test_equal_token_lists_are_scored_once(spark):
    """Rows with equal words share one comparison, and each has its answer; of equal titles the first is best."""
    q = spark.createDataFrame([(i, ["steel", "door"] if i % 2 else ["oak", "frames"]) for i in range(40)] + [(90, []), (91, None), (92, ["door", "door", "x"])], "query_id long, tokens array<string>")
    t = spark.createDataFrame([(i, ["steel", "doors"]) for i in range(9, 3, -1)] + [(20, ["frame", "oaks"]), (1, ["oak"]), (0, [])], "title_id long, tokens array<string>")
    out = joins.best_title(q, t, 0.5)
    assert {(r.query_id, r.title_id, round(r.score, 3)) for r in out.collect()} == {(i, 4, 1.0) for i in range(1, 40, 2)} | {(92, 4, 0.667)}
    paired = out._jdf.queryExecution().optimizedPlan().toString().split("_stem")
    assert "Aggregate [_q" in paired[-1] + "".join(paired[:-1]) and "Aggregate [query_id" not in "".join(paired)
