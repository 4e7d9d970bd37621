"""The job stream against the same events folded one by one, its timers, and finished jobs written as one."""

import datetime as dt
import random
import tempfile

from tessella.operators import relational
from tessella.streaming import job_stream

T0 = dt.datetime(2024, 1, 1)
EVENTS = "job_id long, event string, at timestamp, seq long"


def run(spark, rows, **kw):
    """Final states by job of these events."""
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(j, e, T0 + dt.timedelta(microseconds=t), s) for j, e, t, s in rows], EVENTS).write.parquet(f"{at}/in")
    got = job_stream.drain(job_stream.run_jobs(spark.readStream.schema(EVENTS).parquet(f"{at}/in"), **kw), "q", "update", f"file://{at}/check")
    rows = relational.latest(got, ["job_id"], ["at", "attempt"], ["status", "attempt", "at"]).collect()
    return {r.job_id: (r.status, r.attempt, (r.at - T0) // dt.timedelta(microseconds=1)) for r in rows}


def fold(rows, watermark, lease=1800, most=3):
    """By the rules of the queue, written out: one event after the other, then the clock."""
    out = {}
    for j, e, t, s in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        status, n, seen = out.get(j, ("", 0, 0))
        if status == "RUNNING" and t > seen + lease * 10**6:
            status, seen = ("FAILED" if n >= most else "QUEUED"), seen + lease * 10**6
        if (status, e) == ("", "SUBMIT"):
            status, seen = "QUEUED", t
        elif (status, e) == ("QUEUED", "CLAIM"):
            status, n, seen = "RUNNING", n + 1, t
        elif status == "RUNNING" and e in ("HEARTBEAT", "SUCCEED", "FAIL"):
            status, seen = {"HEARTBEAT": "RUNNING", "SUCCEED": "SUCCEEDED", "FAIL": "FAILED"}[e], t
        out[j] = (status, n, seen)
    for j, (status, n, seen) in out.items():
        if status == "RUNNING" and seen + lease * 10**6 < watermark:
            out[j] = ("FAILED" if n >= most else "QUEUED", n, seen + lease * 10**6)
    return {j: x for j, x in out.items() if x[0]}


def test_states_equal_a_fold_of_the_events(spark):
    r = random.Random(5)
    rows = []
    for j in range(60):
        t = r.randrange(10**9)
        for s in range(r.randint(1, 9)):
            rows.append((j, r.choice(["SUBMIT", "CLAIM", "CLAIM", "HEARTBEAT", "SUCCEED", "FAIL"]) if s else "SUBMIT", t, s))
            t += r.choice([0, 1, 999_999, 10**6, 900 * 10**6, 1801 * 10**6, 1800 * 10**6])
    watermark = max(t for _, _, t, _ in rows) // 1000 * 1000 - 600 * 10**6
    assert run(spark, rows) == fold(rows, watermark)


def test_events_of_one_second_keep_their_order(spark):
    rows = [(1, "SUBMIT", 5, 0), (1, "CLAIM", 6, 1), (1, "SUCCEED", 7, 2), (2, "SUBMIT", 5, 0), (2, "CLAIM", 5, 1), (2, "SUCCEED", 5, 2)]
    assert run(spark, rows) == {1: ("SUCCEEDED", 1, 7), 2: ("SUCCEEDED", 1, 5)}


def test_a_lease_runs_out_by_the_watermark(spark):
    hour = 3600 * 10**6
    rows = [(1, "SUBMIT", 0, 0), (1, "CLAIM", 1, 1), (2, "SUBMIT", 5 * hour, 0)]
    assert run(spark, rows)[1] == ("QUEUED", 1, 1 + 1800 * 10**6)
    assert run(spark, rows, most=1)[1] == ("FAILED", 1, 1 + 1800 * 10**6)


def test_registered_stream_equals_a_fold(spark):
    from compare import SF

    from tessella.plans.catalog import QUERIES

    kind = {"view": "SUBMIT", "click": "CLAIM", "signup": "HEARTBEAT", "purchase": "SUCCEED"}
    epoch = dt.datetime(1970, 1, 1)
    micros = lambda t: (t - epoch) // dt.timedelta(microseconds=1)
    rows = [(e.user_id, kind.get(e.event_type, "FAIL"), micros(e.ts), e.event_id) for e in spark.read.parquet(f"{SF}/events.parquet").collect()]
    watermark = max(t for _, _, t, _ in rows) // 1000 * 1000 - 600 * 10**6
    got = {r.job_id: (r.status, r.attempt, micros(r.at)) for r in QUERIES["queue_stream"](spark, SF).collect()}
    assert got == fold(rows, watermark) and len(got) > 10


def test_finished_jobs_come_with_their_results(spark):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "job_id long, status string, payload string"
    spark.createDataFrame([(1, "SUCCEEDED", "a"), (2, "FAILED", None), (3, "SUCCEEDED", "c")], schema).write.parquet(f"{at}/in")
    job_stream.write_finished(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/check").awaitTermination()
    got = job_stream.read_finished(spark, f"{at}/out")
    assert sorted((r.job_id, r.status, r.payload) for r in got.collect()) == [(1, "SUCCEEDED", "a"), (2, "FAILED", None), (3, "SUCCEEDED", "c")]
    # results of a batch whose states are not there yet are not seen
    spark.createDataFrame([(9, "x")], "job_id long, payload string").write.parquet(f"{at}/out/results/batch=99")
    assert got.count() == 3 and job_stream.read_finished(spark, f"{at}/out").count() == 3
