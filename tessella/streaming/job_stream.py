"""The job queue and the notification feed as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event does to a job: the status it leads to.
STEPS = {"SUBMIT": "QUEUED", "CLAIM": "RUNNING", "HEARTBEAT": "RUNNING", "SUCCEED": "SUCCEEDED", "FAIL": "FAILED"}
LEASE_SECONDS, MAX_ATTEMPTS = 1800, 3
#: Seconds, by the watermark, for which a finished job is remembered, so that events that come late don't revive it.
REMEMBERED = 86_400
STATE = "status string, attempt int, seen long"
OUT = "job_id long, status string, attempt int, micros long"
ENDED = ("SUCCEEDED", "FAILED")


def expired(state: tuple[str, int, int], lease: int, most: int) -> tuple[str, int, int]:
    """The state after a running job's lease ran out: back in the queue, or failed at the last attempt."""
    _, attempt, seen = state
    return ("FAILED" if attempt >= most else "QUEUED", attempt, seen + lease)


def step(state: tuple[str, int, int], event: str, at: int, lease: int, most: int) -> tuple[str, int, int]:
    """(status, attempt, time) after an event; a lease is in the unit of times.  One that ran out before it first requeues
    the job, or fails it at its last attempt; events that don't fit the status change nothing, nor does
    anything after the end."""
    if state[0] == "RUNNING" and at > state[2] + lease:
        state = expired(state, lease, most)
    status, attempt, _ = state
    if event == "SUBMIT" and status == "":
        return "QUEUED", 0, at
    if event == "CLAIM" and status == "QUEUED":
        return "RUNNING", attempt + 1, at
    if event in ("HEARTBEAT", "SUCCEED", "FAIL") and status == "RUNNING":
        return STEPS[event], attempt, at
    return state


def run_jobs(events: DataFrame, *, lease: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS, delay: str = "10 minutes") -> DataFrame:
    """Streaming events (job_id, event, at: timestamp, seq) to job states, one row for each batch that changes a
    job's state.  A job's events are put in order of time, then of seq, within a batch; a running job whose
    lease runs out by the watermark is requeued or failed by a timer, and a finished one is forgotten by one."""

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = now = tuple(state.get) if state.exists else ("", 0, 0)
        if state.hasTimedOut and now[0] in ENDED:
            state.remove()
            return
        if state.hasTimedOut:
            now = expired(now, lease * 1_000_000, most)
        else:
            rows = sorted((int(t), int(n), e) for f in frames for t, n, e in zip(f["micros"], f["seq"], f["event"]))
            for at, _, event in rows:
                now = step(now, event, at, lease * 1_000_000, most)
        if now[0] == "":
            return  # nothing has been submitted
        state.update(now)
        if now[0] in ("RUNNING", *ENDED):
            wait = lease if now[0] == "RUNNING" else REMEMBERED
            state.setTimeoutTimestamp(max(now[2] // 1000 + wait * 1000, state.getCurrentWatermarkMs() + 1))
        if now != before:
            yield pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "attempt": [now[1]], "micros": [now[2]]})

    # times cross to Python as numbers, which no time zone moves
    keyed = events.withWatermark("at", delay).withColumn("micros", F.unix_micros("at")).groupBy("job_id")
    changes = keyed.applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return changes.select("job_id", "status", "attempt", F.timestamp_micros("micros").alias("at"))


def once_per_key(events: DataFrame, key: list[str], within: str = "30 days") -> DataFrame:
    """Streaming notifications without repeats of a key inside the watermark."""
    return events.withWatermark("at", within).dropDuplicatesWithinWatermark(key)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source holds now and return its output rows, which each batch writes to
    Parquet beside the checkpoint, a folder of its own that a repeated batch overwrites."""
    spark, path = stream.sparkSession, f"{checkpoint}-rows"
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/none")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def write_latest(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch of job states to Parquet with its batch number; readers take the last row of each
    job, so a batch that is written again after a failure does no harm."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_finished(stream: DataFrame, path: str, checkpoint: str):
    """Append finished jobs (job_id, status, payload, ...) as two tables under one batch number: results (payloads of
    those that succeeded) first, then states.  A batch that is written again overwrites both."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("status = 'SUCCEEDED'").select("job_id", "payload").write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        batch.drop("payload").write.mode("overwrite").parquet(f"{path}/states/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_finished(spark: SparkSession, path: str) -> DataFrame:
    """States with their results.  A batch counts when its states are there, which are written last, so neither a
    success without its result nor a result without its success is seen."""
    states, results = spark.read.parquet(f"{path}/states"), spark.read.parquet(f"{path}/results")
    return states.join(results, ["batch", "job_id"], "left").drop("batch")
