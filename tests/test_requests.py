"""Requests against a plain run of them, one after the other, over several batches."""

import random

import pytest

from plumbline.operators import requests

JOB = "job_id string, key string, content string, config string, status string, ord long"
REQUEST = "request_id string, ord long, key string, content string, config string"


def one_by_one(rows, jobs):
    jobs, out = [list(j) for j in jobs], []
    for rid, at, key, content, config in sorted(rows, key=lambda r: r[1]):
        named = next((j for j in jobs if key is not None and j[1] == key), None)
        active = max((j for j in jobs if (j[2], j[3]) == (content, config) and j[4] not in requests.LOST), key=lambda j: (j[5], j[0]), default=None)
        if named:
            out.append((rid, "existing", named[0]) if (named[2], named[3]) == (content, config) else (rid, "conflict", None))
        elif active:
            out.append((rid, "existing", active[0]))
        else:
            jobs.append([rid, key, content, config, "queued", at])
            out.append((rid, "created", rid))
    return sorted(out, key=repr), jobs


@pytest.mark.parametrize("seed", [1, 2])
def test_two_batches(spark, seed):
    draw = random.Random(seed)
    jobs = [(f"j{i}", f"k{i}" if i % 2 else None, f"c{i % 4}", "x", draw.choice(["queued", "failed", "dead", "succeeded"]), i) for i in range(6)]
    stored = spark.createDataFrame(jobs, JOB)
    for batch in range(2):
        rows = [(f"r{batch}-{i}", 100 * batch + 10 + i, draw.choice([None, *(f"k{j}" for j in range(8))]), f"c{draw.randrange(7)}", draw.choice("xy")) for i in range(30)]
        df = spark.createDataFrame(rows, REQUEST)
        got = requests.submit(df, stored)
        want, jobs = one_by_one(rows, jobs)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
        stored = requests.with_created(stored, df, got)
        assert sorted(tuple(r) for r in stored.select("job_id").collect()) == sorted((j[0],) for j in jobs)


def test_nothing(spark):
    assert requests.submit(spark.createDataFrame([], REQUEST), spark.createDataFrame([], JOB)).collect() == []
