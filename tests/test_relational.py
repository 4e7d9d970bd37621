from pyspark.sql import functions as F

from tessella.operators import diagnostics, jobs, relational, retrieval


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def walk(rows, limit):
    cursor, pages, more = None, [], []
    while True:
        got = relational.keyset_page(rows, "t", "id", limit, cursor).orderBy(F.col("t").desc(), F.col("id").desc()).collect()
        if not got:
            break
        pages.append([r.id for r in got])
        more.append(got[0].has_more)
        cursor = relational.decode_cursor(relational.encode_cursor(got[-1].t, got[-1].id))
        if not more[-1]:
            break
    return pages, more


def test_keyset_walks(spark):
    rows = spark.createDataFrame([(i, f"2024-01-0{i}") for i in range(1, 6)], "id long, t string")
    pages, more = walk(rows, 2)
    assert [len(p) for p in pages] == [2, 2, 1] and more == [True, True, False]
    ties = spark.createDataFrame([(i, "2024-01-01") for i in range(6)], "id long, t string")
    pages, _ = walk(ties, 2)
    assert sorted(sum(pages, [])) == list(range(6))
    assert relational.decode_cursor("nonsense") is None and relational.decode_cursor(None) is None


def test_guarded_update(spark):
    rows = spark.createDataFrame([(1, None), (2, "old"), (3, None)], "id int, read_at string")
    n = lambda ids: {r.id: (r.affected, r.read_at) for r in relational.guarded_update(rows, "read_at", F.lit("new"), ids).collect()}
    assert n(None) == {1: (True, "new"), 2: (False, "old"), 3: (True, "new")}
    assert not any(a for a, _ in n([]).values())
    assert n([1, 2]) == {1: (True, "new"), 2: (False, "old"), 3: (False, None)}
    twice = relational.guarded_update(relational.guarded_update(rows, "read_at", F.lit("new"), None).drop("affected"), "read_at", F.lit("later"), None)
    assert not any(r.affected for r in twice.collect())


def test_first_and_last_win(spark):
    new = spark.createDataFrame([("k", 2), ("k", 1), ("m", 3), (None, 4), (None, 5)], "k string, n int")
    old = spark.createDataFrame([("m", 0)], "k string, n int")
    assert sorted((r.k or "", r.n) for r in relational.first_wins(new, ["k"], ["n"], old).collect()) == [("", 4), ("", 5), ("k", 1)]
    got = relational.last_wins(spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, t int, v string"), spark.createDataFrame([("a", 1, "new"), ("b", 4, "new")], "k string, t int, v string"), ["k"], ["t"])
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", "new"), ("b", "old")]


def test_profile_and_withdrawal(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "user_id int, nickname string, nickname_at string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "user_id int, nickname string")
    got = {r.user_id: (r.nickname, r.nickname_at) for r in relational.upsert_profile(old, new, F.lit("t1")).collect()}
    assert got == {1: ("a", "t0"), 2: ("c", "t1"), 3: ("d", "t1")}
    users = spark.createDataFrame([(False, "x"), (True, None), (None, None)], "is_deleted boolean, deleted_at string")
    assert [r[0] for r in users.select(relational.withdrawn()).collect()] == [True, True, False]


def test_lease_recovery_is_idempotent(spark):
    rows = [(1, 1, "RUNNING", 1), (2, 1, "RUNNING", 3), (3, 2, "RUNNING", 1), (4, 2, "QUEUED", 0)]
    s = spark.createDataFrame(rows, "job_id int, user_id int, status string, attempt int")
    lease = F.when(F.col("job_id") == 3, ts("2024-01-02")).when(F.col("status") == "RUNNING", ts("2024-01-01 00:00:00"))
    s = s.withColumns({"queued_at": ts("2023-12-31"), "started_at": ts("2023-12-31"), "lease_until": lease, "locked_by": F.lit("w")})
    now = ts("2024-01-01 00:00:01")
    got = {r.job_id: r for r in jobs.recover(s, now).collect()}
    assert [(got[i].status, got[i].recovery) for i in (1, 2, 3, 4)] == [("QUEUED", "requeued"), ("FAILED", "failed"), ("RUNNING", None), ("QUEUED", None)]
    assert got[1].locked_by is None and got[1].lease_until is None
    once = jobs.recover(s, now)
    assert [r.dedupe_key for r in jobs.notices(once).collect()] == ["analysis:2:FAILED"]
    assert jobs.recover(once.drop("recovery"), now).where("recovery is not null").count() == 0
    assert jobs.recover(s, ts("2024-01-01 00:00:00")).where("recovery is not null").count() == 0  # strictly before
    claimed = jobs.claim(once, "w2", now).collect()
    assert [(r.job_id, r.attempt) for r in claimed] == [(4, 1)]


def test_rank_fusion_ties(spark):
    a = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate("abc")], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate("cda")], "query_id int, id string, rank int")
    got = retrieval.fuse(a, b, key="id", top=4).orderBy("place").collect()
    assert [r.id for r in got] == ["a", "c", "b", "d"]
    assert abs(got[0].score - 0.0322665) < 1e-6 and abs(got[2].score - 0.016129) < 1e-6


def test_dense_topk_filters_after_the_limit(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.0, 0.0], 1), (4, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in retrieval.dense_topk(e, [1.0, 0.1], k=1, min_score=0.99).collect()] == [1]
    assert retrieval.dense_topk(e, [1.0, 0.1], k=1, issues=[1], min_score=0.5).count() == 0
    assert retrieval.dense_topk(e, [1.0, 0.1], issues=[]).count() == 0
    assert retrieval.dense_topk(e, [1.0, 0.1], min_score=None).count() == 2


def test_answer_loop_rewrites_once(spark):
    schema = "id int, similarity double, text string"
    search = lambda q: spark.createDataFrame({"bad": [(1, 0.2, "x"), (2, 0.1, "y")], "good": [(3, 0.6, "x"), (4, 0.3, "z")]}[q], schema)
    hits, route, n = retrieval.answer_hits(search, "bad", lambda q: "good")
    assert (route, n) == ("generate", 1)
    assert sorted(r.id for r in hits.collect()) == [2, 3, 4]
    assert retrieval.answer_hits(search, "good", lambda q: q)[2] == 0


def test_exclusive_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 10)] + [("b", 7)], "g string, length long")
    got = {r.g: r for r in diagnostics.quantiles(df, ["g"]).collect()}
    assert (got["a"].p90, got["a"].p50, got["a"].mean) == (12.4, 3, 4.0) and abs(got["a"].p99 - 15.6) < 0.05
    assert (got["b"].p90, got["b"].min, got["b"].max) == (7.0, 7, 7)


def test_merged_counts(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"a": 3}), (2, {})], "g int, counts map<string,int>")
    got = {r.g: r.counts for r in relational.merge_counts(df, ["g"], "counts").collect()}
    assert got == {1: {"a": 4, "b": 2}, 2: {}}
