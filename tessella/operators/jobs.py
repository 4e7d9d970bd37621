"""The job queue as batch transforms: fold an event log into job states, claim, and recover leases.

States are rows (job_id, user_id, status, attempt, queued_at, started_at, lease_until, locked_by).
`now` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import latest

#: States that are active and terminal, seconds of a lease, attempts.
ACTIVE, TERMINAL = ("QUEUED", "RUNNING"), ("SUCCEEDED", "FAILED", "CANCELED")
LEASE, MAX_ATTEMPTS = 1800, 3
#: The key of the greeting, and the stage and progress of a job that is done.
WELCOME = "welcome"
COMPLETED, DONE = "COMPLETED", 100


def after(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def fold(events: DataFrame, order: list[str], take: list[str]) -> DataFrame:
    """The latest state of each job in an event log."""
    return latest(events, ["job_id"], order, take)


def claim(jobs: DataFrame, worker: str, now: Column, *, n: int = 1) -> DataFrame:
    """The n oldest queued jobs, running under a lease of the worker."""
    first = jobs.where("status = 'QUEUED'").orderBy("queued_at", "job_id").limit(n)
    return first.withColumns({"status": F.lit("RUNNING"), "attempt": F.col("attempt") + 1, "locked_by": F.lit(worker), "started_at": now, "lease_until": after(now, LEASE)})


def heartbeat(jobs: DataFrame, job_id, now: Column) -> DataFrame:
    hit = (F.col("job_id") == job_id) & (F.col("status") == "RUNNING")
    return jobs.withColumn("lease_until", F.when(hit, after(now, LEASE)).otherwise(F.col("lease_until")))


def recover(jobs: DataFrame, now: Column, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """jobs after recovery, with `recovery` (requeued, failed or null): a running job whose lease lies before
    now goes to the back of the queue, or fails if its attempts are used up.  Doing it again changes
    nothing."""
    expired = F.coalesce((F.col("status") == "RUNNING") & (F.col("lease_until") < now), F.lit(False))
    back = expired & (F.col("attempt") < max_attempts)
    new = {
        "recovery": F.when(back, "requeued").when(expired, "failed"),
        "status": F.when(back, "QUEUED").when(expired, "FAILED").otherwise(F.col("status")),
        "queued_at": F.when(back, now).otherwise(F.col("queued_at")),
        "locked_by": F.when(~expired, F.col("locked_by")),
        "lease_until": F.when(~expired, F.col("lease_until")),
    }
    return jobs.select(*(F.col(c) for c in jobs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def notices(recovered: DataFrame) -> DataFrame:
    """One notification for each job that recovery failed, by its key."""
    return recovered.where("recovery = 'failed'").select("user_id", notice_key(F.col("job_id"), F.lit("FAILED")).alias("dedupe_key"))


def notice_key(job_id: Column, status: Column) -> Column:
    """The key of a job's notification: one for each way that a job may stand."""
    return F.concat_ws(":", F.lit("analysis"), job_id.cast("string"), status)


def submit(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (request_id, user_id, idempotency_key) with outcome and job_id.  A request whose key the user's jobs
    have already is that job sent again (returned), whatever its state; else one of a user with an active job is
    refused (conflict); else it becomes a job (created, job_id null).  Of a user's requests, by request_id, the
    first without a key match is created; a later one with its key is returned to it, others are refused."""
    known = jobs.where("idempotency_key is not null").groupBy("user_id", "idempotency_key").agg(F.min("job_id").alias("job_id"))
    busy = jobs.where(F.col("status").isin(*ACTIVE)).select("user_id").distinct().withColumn("_busy", F.lit(True))
    r = requests.join(known, ["user_id", "idempotency_key"], "left").join(busy, "user_id", "left")
    fresh = F.col("job_id").isNull() & F.col("_busy").isNull()
    first = F.min(F.when(fresh, F.struct("request_id", "idempotency_key"))).over(W.partitionBy("user_id"))
    r = r.withColumn("_first", first)
    outcome = (
        F.when(F.col("job_id").isNotNull(), "returned")
        .when(fresh & (F.col("request_id") == F.col("_first.request_id")), "created")
        .when(fresh & (F.col("idempotency_key") == F.col("_first.idempotency_key")), "returned")
        .otherwise("conflict")
    )
    return r.select("request_id", "user_id", "idempotency_key", outcome.alias("outcome"), "job_id")


def finish(jobs: DataFrame, outputs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, results): running jobs that have an output (job_id, payload) succeed, done and without a lease, and
    these outputs are their results; others stay, and so no job succeeds without a result or has one unfinished."""
    got = outputs.select(F.col("job_id").alias("_of"), "payload")
    hit = (F.col("status") == "RUNNING") & F.col("_of").isNotNull()
    both = jobs.join(got, jobs["job_id"] == F.col("_of"), "left").withColumn("_hit", hit)
    new = {"status": F.lit("SUCCEEDED"), "stage": F.lit(COMPLETED), "progress": F.lit(DONE), "finished_at": now, "lease_until": F.lit(None)}
    cols = [F.when(F.col("_hit"), v).otherwise(F.col(c) if c in jobs.columns else F.lit(None)).alias(c) for c, v in new.items()]
    states = both.select(*(c for c in jobs.columns if c not in new), *cols)
    return states, both.where("_hit").select("job_id", "user_id", "payload")


def crowded(jobs: DataFrame) -> DataFrame:
    """Users with more than one active job: what the unique rule forbids."""
    return jobs.groupBy("user_id").agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("n_active")).where("n_active > 1")
