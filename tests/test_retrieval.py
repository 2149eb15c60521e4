import math

from plumbline.operators import retrieval


def test_best_over_blocks(spark, monkeypatch):
    """The best documents over several blocks of documents and queries, with ties and wanted ones, as by plain counting."""
    monkeypatch.setattr(retrieval, "DOCS", 7)
    monkeypatch.setattr(retrieval, "ITEMS", 3)
    tf = [(d, 5 + d % 4, t, 1 + (d * len(t)) % 3) for d in range(40) for t in ("a", "bb", "ccc", "dddd") if (d + len(t)) % 3]
    query = [(i, t, 0.5 + i % 3 + len(t), 6.5) for i in range(8) for t in ("a", "bb", "ccc", "e") if (i + len(t)) % 4]
    wanted = [(i, 3 * i) for i in range(8)]
    want = {}
    for i, t, idf, mean in query:
        for d, dl, u, n in tf:
            if t == u:
                want[i, d] = want.get((i, d), 0) + idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / mean))
    best = {p for i in range(8) for p in sorted((p for p in want if p[0] == i), key=lambda p: (-round(want[p], 9), p[1]))[:4]}
    out = retrieval.best(spark.createDataFrame(query, "item_id long, term string, idf double, mean double"), spark.createDataFrame(tf, "doc_id long, dl int, term string, tf long"), 4, 1.5, 0.75, spark.createDataFrame(wanted, "item_id long, doc_id long")).collect()
    assert len(out) == len({(r.item_id, r.doc_id) for r in out}) and {(r.item_id, r.doc_id) for r in out} == best | {p for p in wanted if p in want}
    assert all(math.isclose(r.score, want[r.item_id, r.doc_id], abs_tol=1e-8) for r in out)


def test_no_shuffle_by_frequent_terms(spark):
    """Pairs of items and documents are not shuffled: a pair of blocks is one group, whatever its terms."""
    from plumbline.plans import transcripts

    plan = transcripts.scored(spark, "/root/testdata/sf0.001", 5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "item_id#" in plan and "hashpartitioning(term#" not in plan.split("FlatMapCoGroupsInPandas")[0]
