import tempfile

from tessella.streaming import job_stream


def test_drain_leaves_rows_in_files(spark):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(10).repartition(2).write.parquet(f"{at}/in")
    for name, want in (("some", list(range(10))), ("nothing", [])):
        rows = spark.readStream.schema("id long").parquet(f"{at}/in").where("true" if want else "false")
        got = job_stream.drain(rows, name, "append", f"file://{at}/{name}")
        assert sorted(r.id for r in got.collect()) == want
        assert got.inputFiles() and all(f"{at}/{name}-rows" in x for x in got.inputFiles())
