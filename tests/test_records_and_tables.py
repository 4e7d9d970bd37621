"""JSON lines in many splits, tables by committed batches, and vectors by content."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import records, tables


@pytest.fixture
def folder(spark, tmp_path):
    """Two files: records, blank lines, lines that are no object, records without content."""
    for name, n in (("a", 300), ("b", 40)):
        lines = []
        for i in range(n):
            if i % 7 == 3:
                lines.append(["", "   ", "[1, 2]", "{broken", '{"page_content": "  "}'][i % 5])
            else:
                lines.append(json.dumps({"page_content": f" {name} {i} é ", "metadata": {"k": i} if i % 2 else None}))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "c.txt").write_text("no record")
    return str(tmp_path)


def plain(folder, limit=None):
    good, bad = [], []
    for name in "ab":
        mine = []
        for no, line in enumerate(open(f"{folder}/{name}.jsonl", encoding="utf-8").read().split("\n")[:-1], 1):
            line = line.strip()
            try:
                value = json.loads(line) if line else None
            except ValueError:
                value = line
            if isinstance(value, dict) and value["page_content"].strip():
                mine.append((f"{name}.jsonl", no, value["page_content"].strip(), {k: str(v) for k, v in (value.get("metadata") or {}).items()}))
            elif line and not isinstance(value, dict):
                bad.append((f"{name}.jsonl", no, line))
        good += mine[:limit]
    return good, bad


@pytest.mark.parametrize("limit", [None, 0, 1, 50, 10_000])
@pytest.mark.parametrize("size", ["500", "100m"])
def test_records_of_many_splits(spark, folder, limit, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        paths = records.list_records(spark, folder)
        got, rejects = records.read_records(spark, paths, limit=limit)
        name = F.element_at(F.split("file", "/"), -1)
        rows = [(r[0], *r[1:]) for r in got.select(name, "line_no", "content", "metadata").collect()]
        bad = [tuple(r) for r in rejects.select(name, "line_no", "line").collect()]
        splits = records.read_lines(spark, paths).select("file", "split").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = plain(folder, limit)
    assert sorted(rows, key=repr) == sorted(want[0], key=repr) and sorted(bad) == sorted(want[1])
    assert splits > 20 if size == "500" else splits == 2


def test_texts_are_not_shuffled(spark, folder):
    plan = records.read_records(spark, records.list_records(spark, folder))[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_listing(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in records.list_records(spark, folder)] == ["a.jsonl", "b.jsonl"]
    assert [p.rsplit("/", 1)[1] for p in records.list_records(spark, folder, "b.jsonl, a.jsonl")] == ["b.jsonl", "a.jsonl"]
    with pytest.raises(FileNotFoundError, match="z.jsonl"):
        records.list_records(spark, folder, "a.jsonl,z.jsonl")


def test_records_as_a_stream(spark, folder, tmp_path):
    from tessella.streaming.job_stream import drain

    got = drain(records.stream_records(spark, folder, files_a_trigger=1), "records", "append", str(tmp_path / "cp"))
    good, bad = plain(folder)
    assert sorted(r.content for r in got.where("reject is null").collect()) == sorted(g[2] for g in good)
    assert sorted(r.reject for r in got.where("reject is not null").collect()) == sorted(b[2] for b in bad)


SCHEMA = "id long, source string"


def numbers(spark, a, b):
    return spark.range(a, b).select("id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))


def test_batches_count_once(spark, tmp_path):
    at = str(tmp_path / "t")
    assert tables.read_table(spark, at, SCHEMA).count() == 0
    assert tables.append_batch(numbers(spark, 0, 10), at, "one") and not tables.append_batch(numbers(spark, 0, 10), at, "one")
    assert tables.append_batch(numbers(spark, 10, 30), at, "two")
    broken = numbers(spark, 30, 40).withColumn("id", F.when(F.col("id") == 35, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        tables.append_batch(broken.repartition(4), at, "three")
    numbers(spark, 90, 99).write.parquet(f"{at}/data/four-left-by-a-killed-job")  # rows without a commit
    assert sorted(r.id for r in tables.read_table(spark, at, SCHEMA).collect()) == list(range(30))
    assert tables.append_batch(numbers(spark, 30, 40), at, "three")
    tables._commit(spark, at, "three", "zzz", [])  # a second commit of the batch, by another writer
    assert sorted(r.id for r in tables.read_table(spark, at, SCHEMA).collect()) == list(range(40))


def test_compaction_replaces_batches(spark, tmp_path):
    at = str(tmp_path / "t")
    for i in range(4):
        tables.append_batch(numbers(spark, 10 * i, 10 * i + 10).repartition(3), at, f"b{i}")
    tables.compact(spark, at, SCHEMA, "source", batch="c1", files=3)
    rows = tables.read_table(spark, at, SCHEMA)
    assert sorted(r.id for r in rows.collect()) == list(range(40)) and tables.commits(spark, at).count() == 1
    assert max(r[1] for r in rows.groupBy(F.input_file_name()).agg(F.count_distinct("source")).collect()) == 1
    assert not tables.append_batch(numbers(spark, 0, 10), at, "b0")  # sent again after compaction
    assert tables.append_batch(numbers(spark, 40, 45), at, "b4") and tables.read_table(spark, at, SCHEMA).count() == 45


def test_only_new_texts_are_embedded(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def embedder(texts):
        import os
        import uuid

        lengths = [len(t) for t in texts]
        with open(os.path.join(str(log), uuid.uuid4().hex), "w") as f:
            f.write(json.dumps([texts, lengths == sorted(lengths)]))
        return [[float(len(t)), 1.0] for t in texts]

    def called():
        got = [json.loads(p.read_text()) for p in log.iterdir()]
        [p.unlink() for p in log.iterdir()]
        assert all(ok for _, ok in got)
        return sorted(t for texts, _ in got for t in texts)

    rows = spark.createDataFrame([(i, None if i == 9 else "x" * (i % 5)) for i in range(20)], "id long, text string").repartition(3)
    store = str(tmp_path / "store")
    got = tables.embed_incremental(rows, "text", store, embedder, 2, batch="1")
    assert {r.id: r.embedding[0] for r in got.collect()} == {i: 0.0 if i == 9 else i % 5 for i in range(20)}
    assert called() == ["x" * i for i in range(5)]
    more = rows.unionByName(spark.createDataFrame([(50, "new")], rows.schema))
    assert tables.embed_incremental(more, "text", store, embedder, 2, batch="2").count() == 21 and called() == ["new"]
    assert tables.embed_incremental(more, "text", store, embedder, 2, batch="3").count() == 21 and called() == []
    with pytest.raises(Exception, match="dimension"):
        tables.embed_incremental(more.withColumn("text", F.lit("other")), "text", store, lambda t: [[1.0]] * len(t), 2, batch="4")
    assert tables.embed_incremental(more, "text", store, embedder, 2, batch="5").count() == 21


def test_find_folder(tmp_path):
    from tessella.sources.pages import find_folder

    (tmp_path / "data").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "data").mkdir()
    assert find_folder("data", str(tmp_path / "a" / "b")) == str(tmp_path / "a" / "data")  # the nearest
    assert find_folder(str(tmp_path / "data"), "/") == str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        find_folder("no-such-folder-here", str(tmp_path))


def test_read_images(spark):
    from tessella.sources.pages import read_images

    rows = [(1, 0, b"a|b"), (1, 1, None), (2, 0, b"")]
    got = read_images(spark.createDataFrame(rows, "doc_id long, page int, image binary"), lambda b: [t for t in b.decode().split("|") if t])
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "a"), (1, 0, 1, "b")]
