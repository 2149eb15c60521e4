"""Submitting requests against the jobs that are there: created, existing or in conflict.

A key names one job for good: the same key with other content is a conflict.  Without a job of its key, a request goes
to the newest active job of the same content and configuration, else it makes a job.  Requests of one batch see the
jobs of those before them.  Nulls in key are no key; failed and dead jobs are not active.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import first_wins
from plumbline.sources.tables import stored

OUTCOME = ["request_id", "outcome", "job_id"]
SAME = ["content", "config"]
#: States of jobs that a new request of the same content replaces.
LOST = ("failed", "dead")


def _settled(open_: DataFrame, jobs: DataFrame) -> DataFrame:
    """``open_`` with outcome and job_id by ``jobs`` (job_id, key, content, config, status, ord); null where none fits."""
    named = jobs.filter("key IS NOT NULL").select("key", F.col("job_id").alias("_by_key"), *(F.col(c).alias(f"_{c}") for c in SAME))
    active = first_wins(jobs.filter(~F.col("status").isin(*LOST)), SAME, [F.desc("ord"), F.desc("job_id")]).select(*SAME, F.col("job_id").alias("_by_content"))
    joined = open_.join(named, "key", "left").join(active, SAME, "left")
    agrees = F.col("content").eqNullSafe(F.col("_content")) & F.col("config").eqNullSafe(F.col("_config"))
    # Behind an open request of the same key, content decides nothing yet: that one may make the key's job.
    by_content = F.col("_by_content").isNotNull() & F.col("first_of_key")
    outcome = F.when(F.col("_by_key").isNotNull() & ~agrees, "conflict").when(F.col("_by_key").isNotNull() | by_content, "existing")
    return joined.withColumn("outcome", outcome).withColumn("job_id", F.when(F.col("outcome") == "existing", F.coalesce("_by_key", "_by_content")))


def submit(requests: DataFrame, jobs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """OUTCOME of ``requests`` (request_id, ord, key, content, config; ord is unique) against ``jobs``; a created job has the request's id.

    Rounds: an open request that is the first of both its key and its content makes a job; what then has a job is
    settled.  The first open request always is one of these, and keys and contents rarely depend on each other in long
    chains, so rounds are few.
    """
    jobs = stored(jobs.select("job_id", "key", *SAME, "status", "ord"), "jobs")
    open_, done = requests.select("request_id", "ord", "key", *SAME), []
    for _ in range(most_rounds):
        open_ = stored(open_, "open")
        by_key = open_.filter("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("_k"))
        by_content = open_.groupBy(*SAME).agg(F.min("ord").alias("_c"))
        marked = open_.join(by_key, "key", "left").join(by_content, SAME, "left")
        marked = marked.select("request_id", "ord", "key", *SAME, F.coalesce(F.col("_k") == F.col("ord"), F.lit(True)).alias("first_of_key"), (F.col("_c") == F.col("ord")).alias("first_of_content"))
        settled = stored(_settled(marked, jobs), "settled")
        done.append(settled.filter("outcome IS NOT NULL").select(*OUTCOME))
        rest = settled.filter("outcome IS NULL")
        makers = stored(rest.filter("first_of_key AND first_of_content").select("request_id", "ord", "key", *SAME), "makers")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        done.append(makers.select("request_id", F.lit("created").alias("outcome"), F.col("request_id").alias("job_id")))
        jobs = jobs.unionByName(makers.select(F.col("request_id").alias("job_id"), "key", *SAME, F.lit("queued").alias("status"), "ord"))
        open_ = rest.join(makers.select("request_id"), "request_id", "left_anti").select("request_id", "ord", "key", *SAME)
    raise RuntimeError("the requests did not settle")


def with_created(jobs: DataFrame, requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``jobs`` and those that a batch made: what the next batch is submitted against."""
    made = requests.join(outcomes.filter("outcome = 'created'").select("request_id"), "request_id", "left_semi")
    return jobs.select("job_id", "key", *SAME, "status", "ord").unionByName(made.select(F.col("request_id").alias("job_id"), "key", *SAME, F.lit("queued").alias("status"), "ord"))
