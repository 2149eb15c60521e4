"""Queries whose results were cut give the whole ones."""

import math
import re
from collections import Counter

from plumbline.plans import service, transcripts


def test_last_text_is_whole(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x" * 1900), (1, 2, "user", "z")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r.conv_id, r.turn, r.text) for r in transcripts.last_texts(spark, str(tmp_path)).collect()] == [(1, 1, "x" * 1900)]


def test_bm25_scores_every_token(spark, tmp_path):
    docs = {1: "a common tale of cats", 2: "a common common dog", 3: "the common bird", 4: "a tale", 5: "nothing here", 6: "cats and cats and common cats"}
    items = {1: "common a common", 2: "Cats, tale! of cats", 3: "absent"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    split = {i: Counter(x.split()) for i, x in docs.items()}
    df = Counter(w for c in split.values() for w in c)
    mean = sum(c.total() for c in split.values()) / len(docs)
    want = set()
    for i, text in items.items():
        score = {d: sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in re.findall(r"\w+", text.lower())) for d, c in split.items()}
        want |= {(i, d, round(x, 6)) for d, x in sorted(score.items(), key=lambda p: (-p[1], p[0]))[:5] if x > 0}
    got = {(r.item_id, r.doc_id, r.score) for r in transcripts.bm25(spark, str(tmp_path)).collect()}
    assert got == want


def test_daily_stream_counts_an_event_once(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "view", 1.0), (1, "2024-01-01 10:00:00", "view", 1.0), (2, "2024-01-01 11:00:00", "view", 2.0), (3, "2024-01-02 10:00:00", "click", 3.0)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((str(r.day), r.event_type, r.n) for r in service.daily_stream(spark, str(tmp_path)).collect()) == [("2024-01-01", "view", 2), ("2024-01-02", "click", 1)]
