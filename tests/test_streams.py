"""Responses and fan-in over streams: any cut into batches gives the batch answer, replayed batches change nothing."""

import datetime
import glob
import os
import random

import pytest

from plumbline.streaming import fan_in, responses

FRAGMENT = "response_id string, seq long, ts timestamp, kind string, id string, name string, text string, input_tokens long, output_tokens long"
START = datetime.datetime(2024, 1, 1)


def fragments(draw, n):
    rows = []
    for r in range(n):
        size, call = draw.randint(1, 8), None
        for i in range(size):
            kind = draw.choice(["text_delta", "reasoning_delta", "tool_call_start", "tool_call_delta"])
            call = f"c{i}" if kind == "tool_call_start" else call
            text = draw.choice(["a", '{"k":', "1}", None, "é"])
            rows.append([f"r{r}", i, START + datetime.timedelta(seconds=r + i), kind, call if kind == "tool_call_start" else None, "tool" if kind == "tool_call_start" else None, text, None, None])
        if r % 4:
            rows.append([f"r{r}", size, START + datetime.timedelta(seconds=r + size), "completed", None, None, None, r, size])
    return rows


def stream_of(spark, folder, batches, schema):
    """Each batch is one file, and the stream takes one file a batch."""
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/made{i}")
        (part,) = glob.glob(f"{folder}/made{i}/*.parquet")
        os.rename(part, f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(writer, folder):
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def tick(days):
    return [None, 0, START + datetime.timedelta(days=days), "tick", None, None, None, None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_of_fragments(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = fragments(draw, 24)
    want = sorted(str(r) for r in responses.at_once(spark.createDataFrame(rows, FRAGMENT)).collect())
    assert any("abandoned" in r for r in want) and any("completed" in r for r in want)
    dealt = [[] for _ in range(3)]
    for row in rows + draw.sample(rows, 9):
        dealt[draw.randrange(3)].append(row)
    # The last file moves the watermark past the gap of what is left open.
    found = responses.responses(stream_of(spark, tmp_path, [*dealt, [tick(1)]], FRAGMENT), "2 HOURS", "1 hour")
    finish(found.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, got)) == want


def test_arguments():
    of = lambda *f: responses.assembled("r", dict(enumerate(f)), "completed")["calls"]
    call = lambda kind, id_, name, text: [kind, id_, name, text, None, None]
    assert of(call("tool_call_delta", None, None, "1")) == [{"id": "orphan", "name": "", "args": "1"}]
    assert of(call("tool_call_start", "a", "t", None), call("tool_call_delta", None, None, "{")) == [{"id": "a", "name": "t", "args": None}]
    assert of(call("tool_call_start", "a", "t", None), call("tool_call_start", "b", "u", None), call("tool_call_delta", "a", None, "{}")) == [{"id": "a", "name": "t", "args": "{}"}, {"id": "b", "name": "u", "args": "{}"}]


REPORT = "job long, shard_index long, shard_count long, status string"


def test_fan_in_releases_once(spark, tmp_path):
    """Reports come twice, in any order; jobs with a shard missing stay; a batch that runs again changes nothing."""
    draw = random.Random(4)
    reports = [(j, i, 3, "dead" if (i + j) % 5 == 0 else "succeeded") for j in range(10) for i in range(3) if (j, i) != (7, 1)]
    reports += draw.sample(reports, 12) + [(7, 1, 3, "failed")]
    draw.shuffle(reports)
    partial = spark.createDataFrame([(j, i, 10 * j + i) for j in range(10) for i in range(3)], "job long, shard_index long, value long")

    def reduce(jobs):
        return jobs.join(partial.groupBy("job").sum("value").toDF("job", "total"), "job")

    sink = fan_in.into_batches(reduce, f"{tmp_path}/out")
    stream = stream_of(spark, tmp_path, [reports[i::4] for i in range(4)] + [reports[:8]], REPORT)
    finish(fan_in.released(stream).writeStream.foreachBatch(sink), tmp_path)
    read = lambda: sorted((r.job, r.shard_count, r.dead, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((j, 3, sum((i + j) % 5 == 0 for i in range(3)), 30 * j + 3) for j in range(10) if j != 7)
    assert read() == want
    # The last commit is lost: the batch runs again.
    commits = [f for f in os.listdir(f"{tmp_path}/state/commits") if f.isdigit()]
    for f in (max(commits, key=int), f".{max(commits, key=int)}.crc"):
        os.remove(f"{tmp_path}/state/commits/{f}")
    finish(fan_in.released(spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).writeStream.foreachBatch(sink), tmp_path)
    assert read() == want
