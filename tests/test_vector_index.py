"""The inverted-file index against exact search."""

import re

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from tessella.operators import retrieval, vector_index


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)


def asked(df):
    return df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def recall(got, want):
    a, b = ({(r.query_id, r[1]) for r in d.select("query_id", d.columns[1]).collect()} for d in (got, want))
    return len(a & b) / len(b)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    r = np.random.RandomState(0)
    centres = r.standard_normal((40, 16))
    x = centres[r.randint(0, 40, 3000)] + 0.5 * r.standard_normal((3000, 16))
    df, path = frame(spark, x), str(tmp_path_factory.mktemp("index"))
    vector_index.build_index(df, path)
    return df, path


def test_recall_and_exact_similarities(spark, clustered):
    df, path = clustered
    got = vector_index.search_index(spark, path, asked(df), k=10)
    want = retrieval.batch_topk(df, asked(df), k=10)
    assert recall(got, want) >= 0.9
    exact = {(r.query_id, r.vec_id): r.similarity for r in retrieval.batch_topk(df, asked(df), k=3000).collect()}
    rows = got.collect()
    assert all(abs(r.similarity - exact[r.query_id, r.id]) < 1e-9 for r in rows)
    assert {r.query_id for r in rows} == {i * 100 for i in range(30)} and all(r.id == r.query_id for r in rows if r.rank == 1)


def test_few_cells_are_read(spark, clustered):
    df, path = clustered
    _, meta = vector_index.open_index(spark, path)
    one = asked(df).where("query_id = 500")
    plan = vector_index.search_index(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    cells = re.search(r"PartitionFilters: \[.*?cell#\d+ (?:IN \(([\d,]*)\)|= (\d+))", plan)
    assert cells and len((cells[1] or cells[2]).split(",")) <= meta["probes"] < 54 / 2
    whole = vector_index.search_index(spark, path, one, probes=10**6)
    assert recall(whole, retrieval.batch_topk(df, one, k=12)) >= 0.9


def test_a_hot_cell_is_split(spark, tmp_path, monkeypatch):
    """A third of the vectors are equal: their cell lies in parts, and equal ones come by smaller id."""
    monkeypatch.setattr(vector_index, "PART", 50)
    r = np.random.RandomState(1)
    x = r.standard_normal((900, 8))
    x[300:600] = x[300]
    df = frame(spark, x)
    vector_index.build_index(df, str(tmp_path))
    parts = spark.read.parquet(f"{tmp_path}/codes").groupBy("cell").agg(F.count_distinct("part").alias("p"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).first()
    assert parts.n >= 300 and parts.p >= 6
    got = vector_index.search_index(spark, str(tmp_path), asked(df).where("query_id = 300"), k=5).collect()
    assert all(abs(r.similarity - 1) < 1e-9 for r in got) and len(got) == 5


def test_unusable_and_no_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 0.1]), (100, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vector_index.build_index(df, f"{tmp_path}/a")
    got = vector_index.search_index(spark, f"{tmp_path}/a", asked(df)).collect()
    assert {(r.query_id, r.id) for r in got} == {(100, 100), (100, 1)}
    vector_index.build_index(df.where("vec_id = 2"), f"{tmp_path}/b")
    assert vector_index.search_index(spark, f"{tmp_path}/b", asked(df)).count() == 0


def test_recall_on_the_given_vectors(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    vector_index.build_index(df, str(tmp_path))
    assert recall(vector_index.search_index(spark, str(tmp_path), asked(df), k=10), retrieval.batch_topk(df, asked(df), k=10)) >= 0.9
