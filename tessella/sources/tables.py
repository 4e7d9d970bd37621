"""Tables that grow by committed batches, and a store of vectors by the content they are of.

A batch's rows are written to a folder of their own; they count once a commit names that folder.  A commit is a
one-row table, which Spark's writer makes visible as a whole, so a batch that fails half-way leaves nothing that is
read, and one that is sent again finds its commit and changes nothing.  Of two commits of one batch the smaller folder
name counts, for everyone.  Compaction writes the rows of many batches into files by one column, under a commit that
replaces theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "batch string, folder string, replaces array<string>"
#: Texts that an embedder gets at a time.
BATCH = 64


def commits(spark: SparkSession, table: str) -> DataFrame:
    """(batch, folder, replaces) of the batches that count."""
    try:
        there = spark.read.schema(_COMMIT).parquet(f"{table}/commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = spark.createDataFrame([], _COMMIT)
    one = there.groupBy("batch").agg(F.min(F.struct("folder", "replaces")).alias("x")).select("batch", "x.*")
    return one.join(one.select(F.explode("replaces").alias("batch")).distinct(), "batch", "left_anti")


def committed(spark: SparkSession, table: str, batch: str) -> bool:
    """Whether the batch has a commit, be it replaced since."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{table}/commits/*").where(F.col("batch") == batch).limit(1).count() > 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _commit(spark: SparkSession, table: str, batch: str, folder: str, replaces: list[str]) -> None:
    one = spark.createDataFrame([(batch, folder, replaces)], _COMMIT).coalesce(1)
    one.write.mode("append").parquet(f"{table}/commits/{folder}")


def append_batch(rows: DataFrame, table: str, batch: str) -> bool:
    """Adds rows as a batch; False, and nothing done, if it is there already."""
    spark = rows.sparkSession
    if committed(spark, table, batch):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/data/{folder}")
    _commit(spark, table, batch, folder, [])
    return True


def read_table(spark: SparkSession, table: str, schema, *, batch: str | None = None) -> DataFrame:
    """The rows of all batches that count, or of one."""
    there = commits(spark, table)
    there = there if batch is None else there.where(F.col("batch") == batch)
    folders = [r["folder"] for r in there.select("folder").collect()]  # one for each batch since compaction
    return spark.read.schema(schema).parquet(*(f"{table}/data/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, table: str, schema, by: str, *, batch: str, files: int = 1) -> None:
    """Writes all rows anew, clustered by a column, as one batch that replaces the others."""
    old = [r["batch"] for r in commits(spark, table).select("batch").collect()]
    folder = f"{batch}-{uuid.uuid4().hex}"
    read_table(spark, table, schema).repartitionByRange(files, by).sortWithinPartitions(by).write.parquet(f"{table}/data/{folder}")
    _commit(spark, table, batch, folder, old)


def content_key(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def embed_incremental(rows: DataFrame, text: str, store: str, embedder: Callable[[list[str]], list[list[float]]], dim: int, *, batch: str) -> DataFrame:
    """rows with `embedding`, the vector of their text.  Vectors are kept in the store by the text's hash: the embedder
    gets each text that the store lacks once, however often rows repeat it, in batches of texts of like length.  A vector of
    another dimension is an error and leaves the store as it was.  A null text counts as empty."""
    spark = rows.sparkSession
    schema = T.StructType().add("content_key", T.StringType()).add("embedding", T.ArrayType(T.FloatType()))
    known = read_table(spark, store, schema)
    new = rows.select(content_key(F.col(text)).alias("content_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    new = new.groupBy("content_key").agg(F.min("_text").alias("_text")).join(known.select("content_key"), "content_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):  # no more texts than these are Python's at a time
                part = batch.slice(at, BATCH)
                got = embedder(part.column(1).to_pylist())
                if any(len(v) != dim for v in got):
                    raise ValueError(f"vectors of another dimension than {dim}")
                vectors = pa.array([list(map(float, v)) for v in got], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["content_key", "embedding"])

    fresh = new.sortWithinPartitions(F.length("_text")).select("content_key", "_text").mapInArrow(run, schema)
    append_batch(fresh, store, batch)
    vectors = read_table(spark, store, schema)
    return rows.withColumn("_key", content_key(F.col(text))).join(vectors.withColumnRenamed("content_key", "_key"), "_key").drop("_key")
