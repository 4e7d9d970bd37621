"""Helpers shared by the corpus operators: tables, shared storage and bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by the engine's own regular expressions: anything but the six ASCII whitespace characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A side may be broadcast up to so many rows, and so many bytes of its texts.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise ValueError("set spark.checkpoint.dir (or the context's checkpoint folder) to a folder that driver and executors share")
    return at.rstrip("/")


#: Tables that materialize() has written and release() has not emptied yet.
_written: list[DataFrame] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, so a lost
    executor costs no recomputation of what came before, and the plan knows the table's real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._at = path
    _written.append(held)
    return held


def release(*tables: DataFrame) -> None:
    """Empty tables that materialize() has written and nothing reads any more."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(t._at)
        _written[:] = [w for w in _written if w is not t]


def cleanup(spark: SparkSession) -> None:
    """Empty every table that the session's operators have written and that is left: those that hold results or that
    results are read from.  Call it once the results are written elsewhere; they can't be computed again after it."""
    release(*[t for t in _written if t.sparkSession is spark])


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and its texts `size` bytes; beyond that df as it
    is, so that the join shuffles (and AQE splits its skewed partitions)."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    each = F.lit(0).cast("long")
    for t in texts:
        each = each + t
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(each)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(text: Column) -> Column:
    """With doc_id, tells rows apart; equal rows share it and get equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def own_name(name: str, taken: list[str]) -> str:
    """A column name of an operator, with underscores after it until no column of the caller has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
