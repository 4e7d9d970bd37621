import json

from pyspark.sql import functions as F

from tessella.operators import service
from tessella.sources import pages


def test_names_and_titles(spark):
    row = spark.range(1).select(
        service.nickname(F.lit(None).cast("string"), F.lit(" "), F.lit("x" * 30)),
        service.display_title(F.lit(""), F.array(F.lit("a.pdf")), "untitled"),
        service.display_title(F.lit(None).cast("string"), F.array().cast("array<string>"), "untitled"),
        service.has_provider(F.lit(None).cast("string"), F.array(F.lit("k")), "k"),
        service.failed_for_display(F.lit("SUCCEEDED"), F.lit(None).cast("string")),
        service.failed_for_display(F.lit("RUNNING"), F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == ("x" * 20, "a.pdf", "untitled", True, True, False)


def test_room_texts(spark):
    rooms = spark.createDataFrame([(1, 7, None, 10), (2, 7, None, 11), (3, 7, None, None), (4, 8, None, 10), (5, 7, None, 12)], "id int, user_id int, deleted_at string, analysis_job_id int")
    jobs = spark.createDataFrame([(10, 7, None), (11, 8, None), (12, 7, None)], "id int, user_id int, deleted_at string")
    results = spark.createDataFrame([(10, json.dumps({"sanitized_text": " body "})), (11, json.dumps({"sanitized_text": "other"})), (12, json.dumps({"sanitized_text": 5}))], "job_id int, payload string")
    assert {r.id: r.text for r in service.room_texts(rooms, jobs, results, 7).collect()} == {1: "body", 2: None, 3: None, 5: None}


def test_backfill_and_touch(spark):
    rooms = spark.createDataFrame([(1, None, None, 3), (2, None, 5, 3), (3, 9, 5, 3)], "id int, last_chat_at int, updated_at int, created_at int")
    filled = service.backfilled_rooms(rooms)
    assert [r.last_chat_at for r in filled.orderBy("id").collect()] == [3, 5, 9]
    messages = spark.createDataFrame([(1, 4), (1, 8), (3, 6)], "room_id int, created_at int")
    assert [r.last_chat_at for r in service.touched(filled, messages).orderBy("id").collect()] == [8, 5, 9]
    notes = spark.createDataFrame([(1, 5, None, None, True, False)], "id int, created_at int, read_at int, deleted_at int, is_read boolean, is_deleted boolean")
    assert tuple(service.backfilled_notifications(notes).first()) == (1, 5, 5, None)


def test_provisioning(spark):
    schema = "user_id int, email string, provider string, nickname string, marketing boolean"
    ids = spark.createDataFrame([(1, "a@x", None, " ", None), (2, "b@x", "k", None, True), (3, "c@x", "email", "C", True), (4, "d@x", None, None, None)], schema)
    out = service.provision(ids, spark.createDataFrame([(4,)], "user_id int"), "k")
    assert sorted(r.nickname for r in out["profiles"].collect()) == ["C", "a"] and out["users"].count() == 2
    got = sorted((r.user_id, r.agreement_type, r.is_agreed) for r in out["agreements"].collect())
    assert len(got) == 6 and (1, "marketing", False) in got and (3, "marketing", True) in got


def test_feeds_and_limits(spark):
    feed = spark.createDataFrame([(1, "COMPLETED", 2), (2, "FAILED", 1), (3, "STARTED", 3), (4, "FAILED", 4)], "id int, type string, created_at int")
    assert service.announcements(feed, None).count() == 0
    assert [r.id for r in service.announcements(feed, spark.createDataFrame([(4,)], "id int")).collect()] == [2, 1]
    files = spark.createDataFrame([(1, "a" * 50_001), (2, "a")] + [(3, "a" * 50_000)] * 4, "job_id int, text string")
    assert {r.job_id: r.verdict for r in service.length_verdict(files).collect()} == {1: "file_too_long", 2: "ok", 3: "job_too_long"}
    messages = spark.createDataFrame([(1, i, i, i == 5) for i in range(14)], "room_id int, id int, created_at int, is_error boolean")
    assert sorted(r.id for r in service.recent_turns(messages).collect()) == [3, 4, 6, 7, 8, 9, 10, 11, 12, 13]


def test_ocr_pages(spark):
    block = {"block_content": "x", "block_bbox": [1, 2, 3, 4]}
    rows = [
        json.dumps({"res": {"page_index": None, "width": 9, "parsing_res_list": [block]}}),
        json.dumps({"page_index": 2, "spotting_res": {"rec_texts": ["a"], "rec_polys": [[[100, 300], [700, 360]]]}, "parsing_res_list": [block]}),
        json.dumps({"spotting_res": {"rec_texts": [" "], "rec_polys": [[[0, 0]]]}, "parsing_res_list": [block]}),
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string").select("i", pages.ocr_page(F.col("p"), F.lit(5)).alias("o"))
    got = [r.o for r in df.orderBy("i").collect()]
    assert [(o.page_index, o.width, [r.text for r in o.regions]) for o in got] == [(5, 9, ["x"]), (2, 0, ["a"]), (5, 0, ["x"])]
    assert tuple(got[1].regions[0].bbox) == (100.0, 300.0, 700.0, 360.0)
