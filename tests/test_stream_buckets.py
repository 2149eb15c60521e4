"""Responses and jobs of one bucket do not disturb each other, and batches are written by many tasks."""

import datetime

from pyspark.sql import functions as F
from test_streams import FRAGMENT, REPORT, START, finish, stream_of

from plumbline.plans import streams
from plumbline.streaming import fan_in, responses


def at(response, seq, minutes, kind, tokens=None):
    return [response, seq, START + datetime.timedelta(minutes=minutes), kind, None, None, "x", tokens, tokens]


def test_responses_of_one_bucket_expire_apart(spark, tmp_path):
    """Each has its own time to expire, also while others get fragments; a repeated fragment begins none again, counts stay whole."""
    large = 2**53 + 1
    batches = [
        [at("a", 0, 0, "text_delta"), at("b", 0, 0, "text_delta"), at("c", 0, 0, "completed", large)],
        [at("b", 1, 100, "text_delta"), at("c", 0, 100, "completed", large), at(None, 0, 100, "tick")],
        [at("b", 2, 110, "completed", 7), at(None, 0, 300, "tick")],
        [at("d", 0, 310, "text_delta")],
        [at(None, 0, 3000, "tick")],
    ]
    found = responses.responses(stream_of(spark, tmp_path, batches, FRAGMENT), "1 HOURS", "10 minutes", 1)
    finish(found.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    got = sorted((r.response_id, r.status, r.text, r.input_tokens) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "abandoned", "x", None), ("b", "completed", "xx", 7), ("c", "completed", "", large), ("d", "abandoned", "x", None)]


def test_jobs_of_one_bucket(spark, tmp_path):
    batches = [[(1, 0, 2, "dead"), (2, 0, 1, "succeeded")], [(2, 0, 1, "succeeded"), (3, 0, 2, "failed")], [(1, 1, 2, "succeeded"), (3, 1, 2, "succeeded")]]
    found = fan_in.released(stream_of(spark, tmp_path, batches, REPORT), 1)
    finish(found.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    assert sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())) == [(1, 2, 1), (2, 1, 0)]


def test_batches_are_not_written_by_one_task(spark):
    df = spark.range(4000).select("id", (F.col("id") % 40).alias("seq"))
    stream, base = streams._streamed(df, "seq", df.limit(1))
    files = spark.read.schema(df.schema).parquet(f"{base}/in")
    assert len(files.inputFiles()) >= 1 + 2 * streams.BATCHES and files.count() == 4001
