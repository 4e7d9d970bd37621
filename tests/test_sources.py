import json

import pytest
from pyspark.sql import functions as F

from tessella.functions.scalars import SUFFIXES
from tessella.sources import pages
from tessella.streaming import job_stream


def test_records_and_rejects(spark, tmp_path):
    lines = [json.dumps({"page_content": " one ", "metadata": {"source_id": "s", "n": 1}}), "", "{broken", "[1]", json.dumps({"page_content": "  "}), json.dumps({"page_content": "two"})]
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    (tmp_path / "a.jsonl").write_text(lines[0])
    paths = pages.resolve(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.jsonl", "b.jsonl"]
    records, rejects = pages.read_records(spark, paths)
    got = sorted((r.content, r.metadata.get("source_id")) for r in records.collect())
    assert got == [("one", "s"), ("one", "s"), ("two", None)] and rejects.count() == 2
    assert pages.read_records(spark, paths, limit=1)[0].count() == 2
    flat = pages.flatten(records).where("source_id is not null").first()
    assert flat.source_id == "s" and flat.metadata["n"] == "1"
    with pytest.raises(FileNotFoundError):
        pages.resolve(spark, str(tmp_path), "a.jsonl,none.jsonl")
    with pytest.raises(FileNotFoundError):
        pages.resolve(spark, str(tmp_path / "a"))


def test_passage_table_and_uploads(spark, tmp_path):
    df = spark.createDataFrame([("c", "guide")], "content string, source_type string")
    for again in (False, False, True):
        pages.write_passages(df, str(tmp_path / "t"), recreate=again)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.pdf").write_bytes(b"abc")
    got = pages.render_pages(pages.read_uploads(spark, str(tmp_path / "u")), lambda data, dpi: [data[i : i + 1] for i in range(len(data))], max_pages=2).collect()
    assert [bytes(r.image) for r in sorted(got, key=lambda r: r.page)] == [b"a", b"b"]


def test_regions(spark):
    df = spark.createDataFrame([(["a ", " "], [[[100.0, 300.0], [700.0, 360.0]], [[0.0, 0.0]]])], "t array<string>, p array<array<array<double>>>")
    got = df.select(pages.spotted_regions(F.col("t"), F.col("p")).alias("r")).first().r
    assert [(r.text, tuple(r.bbox), r.block_id) for r in got] == [("a", (100.0, 300.0, 700.0, 360.0), 0)]
    bad = spark.createDataFrame([(["a"], [])], "t array<string>, p array<array<array<double>>>")
    with pytest.raises(Exception, match="differ"):
        bad.select(pages.spotted_regions(F.col("t"), F.col("p"))).collect()
    blocks = "array<struct<block_content:string,block_bbox:array<double>,block_label:string,block_id:int,block_order:int>>"
    rows = spark.createDataFrame([([("x", [1.0, 2.0, 3.0, 4.0], None, None, None), ("", None, None, 1, None), ("y", [1.0, 2.0, 3.0, 4.0], "title", 9, 2)],)], f"b {blocks}")
    got = rows.select(pages.parsed_regions(F.col("b")).alias("r")).first().r
    assert [(r.text, r.label, r.block_id) for r in got] == [("x", "text", 0), ("y", "title", 9)]


def test_lines_of_words(spark):
    rows = [(1, 1, 1, 2, "b", 5, 0, 9, 4, 80.0), (1, 1, 1, 1, "a", 0, 1, 4, 5, 60.0), (1, 1, 2, 1, "c", 0, 6, 4, 9, -1.0)]
    df = spark.createDataFrame(rows, "block int, par int, line int, word int, text string, x1 int, y1 int, x2 int, y2 int, conf double")
    got = {r.line: (r.text, r.x1, r.y1, r.x2, r.y2, r.conf) for r in pages.lines_of_words(df, []).collect()}
    assert got == {1: ("a b", 0, 0, 9, 5, 70.0), 2: ("c", 0, 6, 4, 9, None)}


def test_upload_merge(spark):
    names = [("old.pdf", True), ("a.txt", False), ("big.pdf", False), ("old.pdf", False), ("n1.pdf", False), ("n1.pdf", False), ("n2.pdf", False), ("n2.pdf", False)]
    rows = [(1, i, e, n, 100 if n == "big.pdf" else 5, 0) for i, (n, e) in enumerate(names)]
    df = spark.createDataFrame(rows, "session int, position int, existing boolean, name string, size int, modified int")
    done = pages.merge_uploads(df, 1, max_bytes=50, suffixes=SUFFIXES)
    assert [r.verdict for r in done.orderBy("position").collect()] == ["existing", "extension", "size", "duplicate", "taken", "duplicate", "limit", "limit"]
    notes = pages.rejection_notices(done).orderBy("place").collect()
    assert [(r.reason, r.target) for r in notes] == [("extension", "a.txt"), ("size", "big.pdf"), ("limit", "n2.pdf +1"), ("duplicate", "old.pdf +1")]


def test_job_steps():
    s, path = ("", 0, 0), []
    for event, at in [("CLAIM", 1), ("SUBMIT", 2), ("CLAIM", 3), ("CLAIM", 4), ("HEARTBEAT", 1000), ("CLAIM", 4000), ("SUCCEED", 4100), ("FAIL", 4200)]:
        s = job_stream.step(s, event, at, 1800, 3)
        path.append(s[:2])
    assert path == [("", 0), ("QUEUED", 0), ("RUNNING", 1), ("RUNNING", 1), ("RUNNING", 1), ("RUNNING", 2), ("SUCCEEDED", 2), ("SUCCEEDED", 2)]
    assert job_stream.step(("RUNNING", 3, 0), "HEARTBEAT", 2000, 1800, 3)[0] == "FAILED"
