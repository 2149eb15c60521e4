"""Fan-in: the last finished shard of a job releases its reduce, once.

A shard is finished when it succeeded or is dead; it may be reported again.  State is the set of finished shards of
each job of a bucket, as a call of Python for each job would cost more than its work; the job is released in the micro-batch that completes it.  What a batch releases is reduced and written to
the batch's own folder, so a batch that runs again after a failure writes the same rows over themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELEASED = "job long, shard_count long, dead long"
#: Buckets that jobs are dealt to by a hash.
BUCKETS = 4096


def released(reports: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """RELEASED rows of a stream of ``reports`` (job, shard_index, shard_count, status); other states than succeeded and dead do not count."""
    import pandas as pd

    def step(key, frames: Iterator, state) -> Iterator:
        # Of every job: its finished shards, 1 for a dead one; null for one that was released.
        held = json.loads(state.get[0]) if state.exists else {}
        totals = {}
        for frame in frames:
            for job, i, n, dead in zip(*(frame[c].tolist() for c in ("job", "shard_index", "shard_count", "dead")), strict=True):
                done = held.setdefault(job, {})
                # A job that was released stays as a mark, so that a late report does not release it again.
                if done is not None:
                    done.setdefault(str(int(i)), dead)
                    totals[job] = int(n)
        full = [job for job, n in totals.items() if len(held[job]) >= n]
        out = pd.DataFrame({"job": [int(job) if job else None for job in full], "shard_count": [totals[job] for job in full], "dead": [sum(held[job].values()) for job in full]})
        held.update(dict.fromkeys(full))
        state.update((json.dumps(held, separators=(",", ":")),))
        if full:
            yield out.astype({"job": "Int64"})

    finished = reports.filter(F.col("status").isin("succeeded", "dead"))
    # Jobs travel as text, the key of a state's map; a null one is empty.
    sent = finished.select(F.coalesce(F.col("job").cast("string"), F.lit("")).alias("job"), "shard_index", "shard_count", (F.col("status") == "dead").cast("int").alias("dead"))
    return sent.withColumn("_bucket", F.pmod(F.xxhash64("job"), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(step, RELEASED, "held string", "append", "NoTimeout")


def into_batches(reduce: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: ``reduce(released jobs)`` goes to the folder of its batch, over what is there."""

    def sink(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink
