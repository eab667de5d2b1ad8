"""Scheduling as predicates over tables of jobs, locks and accounts; `now` is always given."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(now: str) -> Column:
    return F.expr(f"timestamp_ntz '{now}'")


def trigger(pending: DataFrame, least: int, force: bool = False) -> DataFrame:
    """pending and the decision: none-pending, below-threshold or run; force runs below the threshold too."""
    n = F.col("pending")
    decision = F.when(n == 0, "none-pending").when((n < least) & F.lit(not force), "below-threshold").otherwise("run")
    return pending.agg(F.count("*").alias("pending")).withColumn("decision", decision)


def expire(jobs: DataFrame, now: str, hours: int = 3) -> DataFrame:
    """job_id, status: running jobs locked for longer than that are completed."""
    stale = (F.col("status") == "RUNNING") & (F.col("locked_at") < _at(now) - F.expr(f"interval {hours} hours"))
    return jobs.select("job_id", F.when(stale, "COMPLETED").otherwise(F.col("status")).alias("status"))


def locks(held: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """key, recoverable: no holder or time known, expired, or held by a job that is gone or not running."""
    job = F.regexp_extract("locked_by", "^job:(.+)$", 1).alias("job_id")
    found = held.select("key", "locked_by", "locked_at", "expires_at", job).join(jobs.select(F.col("job_id").cast("string").alias("job_id"), "status"), "job_id", "left")
    free = F.col("locked_by").isNull() | F.col("locked_at").isNull() | F.col("expires_at").isNull() | (F.col("expires_at") <= _at(now))
    idle = (F.coalesce(F.col("job_id"), F.lit("")) != "") & (F.coalesce(F.col("status"), F.lit("")) != "RUNNING")
    return found.select("key", (free | idle).alias("recoverable"))


def due(accounts: DataFrame, now: str, hours: int = 12, limit: int = 10) -> DataFrame:
    """account_id, state: cooling if fetched within `hours`, fetched for the `limit` oldest of the others (never fetched last), else waiting."""
    cooling = F.coalesce(F.col("last_fetched") + F.expr(f"interval {hours} hours") > _at(now), F.lit(False))
    marked = accounts.withColumn("cooling", cooling)
    first = marked.where(~F.col("cooling")).orderBy(F.asc_nulls_last("last_fetched"), "account_id").limit(limit).select("account_id", F.lit(True).alias("first"))
    return marked.join(first, "account_id", "left").select("account_id", F.when(F.col("cooling"), "cooling").when(F.col("first"), "fetched").otherwise("waiting").alias("state"))


def next_window(last_end: datetime | None, now: datetime, hours: int = 6) -> tuple[datetime, datetime] | None:
    """The report's next window: it starts where the last ended, or that long ago; None until it has passed."""
    start = last_end or now - timedelta(hours=hours)
    end = start + timedelta(hours=hours)
    return (start, end) if end <= now else None


#: How a post's routing status may change.
MOVES = {"PENDING": ["IGNORED", "AUTO_HIGH", "ROUTED"], "ROUTED": ["LLM_QUEUED"], "LLM_QUEUED": ["COMPLETED", "ROUTED"], "IGNORED": [], "AUTO_HIGH": [], "COMPLETED": []}


def move_allowed(old: Column, new: Column) -> Column:
    out = F
    for status, nexts in MOVES.items():
        out = out.when(old == status, new.isin(nexts) if nexts else F.lit(False))
    return out.otherwise(F.lit(False))


# a queue as a table: job_id, kind, payload, status, attempts, max_attempts, scheduled_at, locked_by


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The new jobs (kind, payload) that no pending or running one equals, each once."""
    active = jobs.where(F.col("status").isin("PENDING", "RUNNING")).select("kind", "payload")
    return new.select("kind", "payload").distinct().join(active, ["kind", "payload"], "left_anti")


def reserved(jobs: DataFrame, now: str, worker: str, limit: int) -> DataFrame:
    """The queue after a worker took the `limit` pending jobs that are due the longest."""
    due_ = (F.col("status") == "PENDING") & (F.col("scheduled_at") <= _at(now))
    taken = jobs.where(due_).orderBy("scheduled_at", "job_id").limit(limit).select("job_id").withColumn("_taken", F.lit(True))
    mine = F.coalesce("_taken", F.lit(False))
    new = {"status": F.lit("RUNNING"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker)}
    return jobs.join(taken, "job_id", "left").select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def settled(jobs: DataFrame, results: DataFrame, now: str, delay_seconds: int = 5) -> DataFrame:
    """The queue after results (job_id, result: done, failed or put-back) of running jobs.

    A failed job is pending again after the delay while it has attempts left, else it has failed; one put back gets its attempt back.
    """
    both = jobs.join(results.select("job_id", "result"), "job_id", "left")
    mine = F.coalesce((F.col("status") == "RUNNING") & F.col("result").isNotNull(), F.lit(False))
    again = (F.col("result") == "put-back") | ((F.col("result") == "failed") & (F.col("attempts") < F.col("max_attempts")))
    new = {
        "status": F.when(F.col("result") == "done", "COMPLETED").when(again, "PENDING").otherwise("FAILED"),
        "attempts": F.when(F.col("result") == "put-back", F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")),
        "scheduled_at": F.when(again, _at(now) + F.expr(f"interval {delay_seconds} seconds")).otherwise(F.col("scheduled_at")),
        "locked_by": F.lit(None),
    }
    return both.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])
