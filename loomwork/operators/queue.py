"""Batch side of the job queue: leases, results and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expire_leases(jobs: DataFrame, now: str, lease_s: int = 900, most: int = 3) -> DataFrame:
    """What to do with processing jobs whose lease is over: requeue, or fail after `most` attempts."""
    late = (F.col("status") == "processing") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(lease_s)))
    return jobs.where(late).select("id", F.when(F.col("attempts") >= most, "fail").otherwise("requeue").alias("action"))


def first_results(events: DataFrame, key: str, order: str, outcome: str) -> DataFrame:
    """First terminal result of each job; the same again is a repeat, another one a conflict."""
    first = events.groupBy(key).agg(F.min_by(F.struct(outcome, order), F.struct(order, outcome)).alias("f"))
    joined = events.join(first, key)
    state = F.when((F.col(order) == F.col(f"f.{order}")) & (F.col(outcome) == F.col(f"f.{outcome}")), "accepted").when(F.col(outcome) == F.col(f"f.{outcome}"), "repeat").otherwise("conflict")
    return joined.select(*events.columns, state.alias("state"))
