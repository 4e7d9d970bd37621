"""Layouts: pages and claims equal those of the plain table and read few rows."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import jobs, relational
from tessella.plans import catalog
from tessella.sources import layouts

from compare import SF


def scanned(df):
    """Rows that the scans of an executed plan have put out, after files and row groups were skipped."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif "FileSourceScan" in name:
            rows += p.metrics().apply("numOutputRows").value()
        else:
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return rows


@pytest.fixture(scope="module")
def notes(spark):
    """4,000 notifications, two thirds of them one owner's, times tied by hundreds."""
    n = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(7).alias("user_id"), F.timestamp_seconds(F.col("id") % 40 * 60).cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("id") % 5 == 0, F.lit("k")).alias("read_at"), F.when(F.col("id") % 11 == 0, F.lit("k")).alias("deleted_at"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), F.col("id").cast("string"))).alias("dedupe_key"),
    )
    return n.repartition(5)


@pytest.mark.parametrize("name, owner", [("alive", 7), ("unread", 7), ("alive", 3), ("alive", 10**6)])
def test_walk_equals_plain_pages(spark, notes, tmp_path, name, owner):
    layout = layouts.NOTES[name]
    layouts.write_layout(notes, layout, str(tmp_path), file_rows=100)
    plain = notes.where(layout.where).where(F.col("user_id") == owner)
    cursor = None
    for _ in range(4):
        want = relational.keyset_page(plain, "created_at", "id", 30, cursor).orderBy(F.desc("created_at"), F.desc("id")).collect()
        got = layouts.owner_page(spark, layout, str(tmp_path), notes.schema, owner, limit=30, cursor=cursor).orderBy(F.desc("created_at"), F.desc("id")).collect()
        assert got == want
        if not got:
            break
        cursor = (str(got[-1]["created_at"]), got[-1]["id"])


def test_a_page_reads_few_rows(spark, notes, tmp_path):
    layouts.write_layout(notes, layouts.NOTES["alive"], str(tmp_path), file_rows=100)
    page = layouts.owner_page(spark, layouts.NOTES["alive"], str(tmp_path), notes.schema, 7, limit=30)
    assert 31 <= scanned(page) <= 250 and scanned(relational.keyset_page(notes.where("deleted_at is null"), "created_at", "id", 30)) == 0
    whole = spark.read.parquet(f"{tmp_path}/rows").where("deleted_at is null and user_id = 7")
    assert scanned(relational.keyset_page(whole, "created_at", "id", 30)) > 2000
    assert spark.read.parquet(f"{tmp_path}/map").count() > 20  # the owner with most rows lies in many files


def test_a_key_is_found_in_one_file(spark, notes, tmp_path):
    layout = layouts.NOTES["dedupe"]
    layouts.write_layout(notes, layout, str(tmp_path), file_rows=100)
    got = layouts.lookup(spark, layout, str(tmp_path), notes.schema, user_id=3, dedupe_key="d123456")
    assert scanned(got) <= 300 and got.count() == 0
    row = notes.where("id = 243 - 3").first()
    assert [r.id for r in layouts.lookup(spark, layout, str(tmp_path), notes.schema, user_id=row.user_id, dedupe_key=row.dedupe_key).collect()] == [240]


def test_queue_lease_and_active_views(spark, tmp_path):
    states = catalog.job_states(spark, SF).withColumn("deleted_at", F.when(F.col("job_id") % 3 == 0, F.col("queued_at")))
    for name in ("queue", "lease", "active"):
        layouts.write_layout(states, layouts.JOBS[name], f"{tmp_path}/{name}", file_rows=50)
    now = F.lit(catalog.NOW).cast("timestamp_ntz")
    first = layouts.oldest(spark, layouts.JOBS["queue"], f"{tmp_path}/queue", states.schema)
    assert scanned(first) <= 60
    assert jobs.claim(first, "w", now).collect() == jobs.claim(states, "w", now).collect()
    lease = layouts.oldest(spark, layouts.JOBS["lease"], f"{tmp_path}/lease", states.schema, 120)
    assert [r.job_id for r in lease.collect()] == [r.job_id for r in states.where("status = 'RUNNING'").orderBy("lease_until", "job_id").limit(120).collect()]
    active = spark.read.parquet(f"{tmp_path}/active/rows")
    assert active.where("deleted_at is not null").count() > 0 and active.count() == states.where("status in ('QUEUED', 'RUNNING')").count()


def test_layouts_of_nothing(spark, notes, tmp_path):
    layouts.write_layout(notes.where("false"), layouts.NOTES["alive"], str(tmp_path))
    assert layouts.owner_page(spark, layouts.NOTES["alive"], str(tmp_path), notes.schema, 7).count() == 0
    assert layouts.oldest(spark, layouts.NOTES["alive"], str(tmp_path), notes.schema).count() == 0
    assert layouts.lookup(spark, layouts.NOTES["dedupe"], str(tmp_path), notes.schema, dedupe_key="x").count() == 0
