"""The pipeline's stages against their own input."""

import re

import numpy as np
from compare import SF
from pyspark.sql import functions as F

import corpus_pipeline as p
from tessella.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = [x.lower() for x in WORD.findall(t or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF), "test")
        seen[name] = (before, docs)
        assert name == "byte_bpe" or docs.columns == columns
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in after.collect()}
    good = [r.doc_id in kept for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id in kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    assert before.join(after, ["doc_id", "text"], "left_semi").count() == after.count()
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    before, after = seen["ngram_jaccard_join"]
    rows = [(r.doc_id, shingle_set(r.text)) for r in before.collect()]
    left = {r.doc_id for r in after.collect()}
    for i, (d, s) in enumerate(rows):
        near = [e for e, t in rows if s and e != d and 100 * len(s & t) >= 80 * len(s | t)]
        assert d in left or near
    held = [(d, s) for d, s in rows if d in left and s]
    assert not any(100 * len(s & t) >= 80 * len(s | t) for i, (_, s) in enumerate(held) for _, t in held[i + 1 :])
    before, after = seen["mix_sources"]
    n = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(n(after) / n(before) - 1.5) < 0.02
    _, after = seen["byte_bpe"]
    assert after.where("not round_trip").count() == 0 and after.agg(F.min("n_tokens")).first()[0] > 0


def test_run_returns_the_last_stage(spark):
    assert p.run(spark, SF).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_stages_with_odd_empty_and_clashing_rows(odd, empty):
    spark = odd.sparkSession
    clash = odd.withColumns({c: F.lit(c) for c in ("_drop", "_kept", "_rest", "_utf8", "_text", "once", "rounds", "n_lines", "component_id", "root", "grp", "bag", "value", "first")})
    kept = {}
    for name, stage in p.STAGES:
        got = stage(spark, clash, SF)
        rows = got.collect()
        kept[name] = len(rows)
        if name != "byte_bpe":
            assert got.columns == clash.columns
            assert all(r[c] == c for r in rows for c in ("_drop", "_kept", "once", "n_lines", "root", "value"))
        assert stage(spark, empty, SF).count() == 0
    # near duplicates: the repeated row goes; mixing: rows without words go
    assert kept["line_dedup"] == kept["byte_bpe"] == 9 and kept["ngram_jaccard_join"] == 8 and kept["mix_sources"] >= 5
