"""Lexical scores don't depend on how work is dealt; cleaning is linear in runs of blanks."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import retrieval
from tessella.plans.catalog import ORACLES


def ranked(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def copies(spark, n=240):
    """Texts of few words with many exact copies, so that whole groups tie."""
    base = ["alpha beta gamma " * 3, "beta gamma delta", "alpha delta delta epsilon zeta", "zeta eta", "alpha beta eta theta iota " * 5]
    return spark.createDataFrame([(i, base[i % 5] + (" pad" * (i % 7 == 0))) for i in range(n)], "doc_id long, text string")


QUESTIONS = ["alpha beta", "delta epsilon alpha beta beta", "zeta eta theta", "nothing here", ""]


def test_copies_tie_however_passages_are_dealt(spark, monkeypatch):
    docs = copies(spark)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")
    got = []
    for parts, slice_ in ((1, 256), (4, 7), (50, 1)):
        monkeypatch.setattr(retrieval, "SLICE", slice_)
        got.append(ranked(retrieval.bm25(docs.repartition(parts), asked, key="doc_id", k=9)))
    assert got[0] == got[1] == got[2] and got[0]
    # of equal scores the smaller ids come first
    mine = [(-s, d) for q, _, d, s in got[0] if q == 1]
    assert mine == sorted(mine) and len({s for s, _ in mine}) < len(mine)


def test_question_groups_and_blocks(spark, monkeypatch):
    docs = copies(spark, 60)
    asked = spark.createDataFrame([(i, QUESTIONS[i % 5] + f" {QUESTIONS[i % 3]}") for i in range(40)], "query_id long, text string")
    want = ranked(retrieval.bm25(docs, asked, key="doc_id", k=3))
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    assert ranked(retrieval.bm25(docs, asked, key="doc_id", k=3)) == want and want


def test_fifty_thousand_questions(spark):
    asked = spark.range(50_000).select(F.col("id").alias("query_id"), F.concat(F.lit("alpha w"), (F.col("id") % 100).cast("string")).alias("text"))
    docs = spark.createDataFrame([(i, f"alpha w{i}") for i in range(100)], "doc_id long, text string")
    got = retrieval.bm25(docs, asked, key="doc_id", k=1).select("query_id", "doc_id")
    assert got.count() == 50_000 and got.where("query_id % 100 <> doc_id").count() == 0


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_hybrid"])
def test_the_sql_has_one_result(duck, name):
    seen = set()
    for run in range(20):
        duck.sql(f"SET threads = {1 + run % 8}")
        seen.add(tuple(sorted(duck.sql(ORACLES[name]).fetchall())))
    assert len(seen) == 1


WIDE = chr(0xA0)


@pytest.mark.parametrize("run", [WIDE * 1_000_000, " " * 1_000_000, (WIDE + "\t") * 500_000])
def test_a_million_blanks(spark, run):
    began = time.time()
    t = f"a{run}b\n{run}\nc{run}"
    assert text.cleaned(t).startswith("a") and text.cleaned(t).endswith("c")
    assert time.time() - began < 3
    df = spark.createDataFrame([(t,)], "t string")
    df.select(text.clean(F.lit("warm"))).collect()
    began = time.time()
    got = df.select(text.clean(F.col("t")).alias("c"), text.strip(F.col("t")).alias("s"), text.strip(F.lit(run)).alias("none")).first()
    assert time.time() - began < 5
    assert got.c == text.cleaned(t) and got.s == t.strip() and got.none == ""


@pytest.mark.parametrize("t", ["", " ", "\n", "a \n b", f"a{WIDE}\nb", f"x{WIDE}{WIDE}\n\n \n\ny ", "a-\r\nb\rc", "é-\né", "a\x0b \t b\t\n", "﻿a　\n", f"{WIDE}\t a {WIDE}"])
def test_both_forms_agree(spark, t):
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(text.clean(F.col("t")).alias("c"), text.strip(F.col("t")).alias("s")).first()
    assert got.c == text.cleaned(t) and got.s == t.strip()
