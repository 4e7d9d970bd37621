"""Merging several tables under one commit."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import merge, service
from tessella.sources import tables

USERS = merge.Target("users", "user_id long, username string", ("user_id",))
PROFILES = merge.Target("profiles", "user_id long, nickname string, hits long", ("user_id",), ("nickname",))


def rows(spark, target, data):
    return spark.createDataFrame(data, target.schema)


def test_classes_values_and_journal(spark, tmp_path):
    at = str(tmp_path)
    first = [(USERS, rows(spark, USERS, [(1, "a"), (2, "b")])), (PROFILES, rows(spark, PROFILES, [(1, "x", 5), (2, None, 6), (None, "lost", 0)]))]
    assert merge.merge_tables(spark, at, first, batch="1") == {"users": {"insert": 2, "update": 0}, "profiles": {"insert": 2, "update": 0}}
    again = [(USERS, rows(spark, USERS, [(2, "other"), (3, "c")])), (PROFILES, rows(spark, PROFILES, [(1, "x", 9), (2, "new", 9), (3, "z", 1), (3, "y", 2)]))]
    assert merge.merge_tables(spark, at, again, batch="2") == {"users": {"insert": 1, "update": 0}, "profiles": {"insert": 1, "update": 1}}
    assert sorted(map(tuple, merge.read_target(spark, at, USERS).collect())) == [(1, "a"), (2, "b"), (3, "c")]  # without values: insert only
    assert sorted(map(tuple, merge.read_target(spark, at, PROFILES).collect())) == [(1, "x", 5), (2, "new", 6), (3, "y", 2)]
    log = [(r.batch, r.target, json.loads(r.key), r.action, r.old and json.loads(r.old), json.loads(r.new)) for r in merge.read_journal(spark, at).collect()]
    assert ("2", "profiles", {"user_id": 2}, "update", {"hits": 6}, {"nickname": "new", "hits": 6}) in log and len(log) == 7


def test_a_rerun_changes_nothing(spark, tmp_path):
    at = str(tmp_path)
    data = [(PROFILES, rows(spark, PROFILES, [(1, "x", 5), (2, None, 6)]))]
    merge.merge_tables(spark, at, data, batch="1")
    none = {"profiles": {"insert": 0, "update": 0}}
    assert merge.merge_tables(spark, at, data, batch="1") == none and merge.merge_tables(spark, at, data, batch="2") == none
    assert merge.read_target(spark, at, PROFILES).count() == 2 and merge.read_journal(spark, at).count() == 2


def test_targets_change_together(spark, tmp_path):
    """A merge that fails at its second target leaves the first as it was, and can be sent again."""
    at = str(tmp_path)
    good = (USERS, rows(spark, USERS, [(1, "a")]))
    broken = rows(spark, PROFILES, [(1, "x", 5)]).withColumn("nickname", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        merge.merge_tables(spark, at, [good, (PROFILES, broken)], batch="1")
    assert merge.read_target(spark, at, USERS).count() == 0 and tables.commits(spark, f"{at}/versions").count() == 0
    assert merge.merge_tables(spark, at, [good, (PROFILES, rows(spark, PROFILES, [(1, "x", 5)]))], batch="1")["users"] == {"insert": 1, "update": 0}
    assert merge.read_target(spark, at, USERS).count() == 1 and merge.read_journal(spark, at).count() == 2


def test_provisioning_twice(spark, tmp_path):
    """New accounts through provision() into four tables; the second run finds them all."""
    at = str(tmp_path)
    targets = {
        "users": USERS,
        "profiles": merge.Target("profiles", "user_id long, nickname string", ("user_id",)),
        "agreements": merge.Target("agreements", "user_id long, agreement_type string, is_agreed boolean", ("user_id", "agreement_type")),
        "notifications": merge.Target("notifications", "user_id long, dedupe_key string", ("user_id", "dedupe_key")),
    }
    people = spark.createDataFrame([(i, f"u{i}@x.org", None, None, i % 2 == 0) for i in range(5)], "user_id long, email string, provider string, nickname string, marketing boolean")
    for batch, want in (("1", [5, 5, 15, 5]), ("2", [0, 0, 0, 0])):
        made = service.provision(people, spark.createDataFrame([], "user_id long"), "kakao")
        got = merge.merge_tables(spark, at, [(targets[k], v) for k, v in made.items()], batch=batch)
        assert [got[k]["insert"] for k in targets] == want and all(x["update"] == 0 for x in got.values())
    assert merge.read_target(spark, at, targets["agreements"]).where("agreement_type = 'marketing' and is_agreed").count() == 3
