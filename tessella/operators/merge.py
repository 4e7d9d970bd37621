"""Several tables merged with what comes in, under one commit, with a journal of what changed.

Each target's rows are classified in one pass, an outer join on its key: insert, update (some value differs) or keep.
The new versions of all targets and the journal are written first; the commit that names them is one row, visible as a
whole, so readers see all targets before it or all after it.  The same batch again finds its commit and does nothing;
the same rows in another batch are all kept and journal nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import append_batch, commits, committed, read_table

_JOURNAL = "target string, key string, action string, old string, new string"
_VERSION = "batch string, target string, folder string, number long"


@dataclass(frozen=True)
class Target:
    """A table of columns `schema` with a key; rows that come in set the columns `values`, and only insert without them."""

    name: str
    schema: str
    key: tuple[str, ...]
    values: tuple[str, ...] = ()


def classify(base: DataFrame, incoming: DataFrame, target: Target) -> DataFrame:
    """(target's columns, action, _old, _new) of base and incoming rows: action is insert, update, or keep.  Of incoming
    rows with one key the first by their values counts; those with a null in the key stay out."""
    columns, key = base.columns, list(target.key)
    rest = [c for c in columns if c not in key]
    one = incoming.select(*columns).where(" and ".join(f"`{k}` is not null" for k in key))
    one = one.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_in")) if rest else one.distinct().withColumn("_in", F.struct(F.lit(1).alias("_")))
    held = base.withColumn("_base", F.struct(*rest) if rest else F.struct(F.lit(1).alias("_")))
    both = held.select(*key, "_base").join(one, key, "full_outer")
    new = {c: F.when(F.col("_base").isNull(), F.col("_in")[c]).when(F.col("_in").isNotNull() & F.lit(c in target.values), F.col("_in")[c]).otherwise(F.col("_base")[c]) for c in rest}
    differs = F.lit(False)
    for c in target.values:
        differs = differs | (F.col("_in").isNotNull() & ~F.col("_in")[c].eqNullSafe(F.col("_base")[c]))
    action = F.when(F.col("_base").isNull(), "insert").when(differs, "update").otherwise("keep")
    out = both.select(*key, *(v.alias(c) for c, v in new.items()), action.alias("action"), F.when(F.col("_base").isNotNull(), F.to_json("_base")).alias("_old"))
    return out.withColumn("_new", F.to_json(F.struct(*rest)) if rest else F.lit("{}")).select(*columns, "action", "_old", "_new")


def _versions(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each target's newest version."""
    rows = read_table(spark, f"{root}/versions", _VERSION)
    newest = rows.groupBy("target").agg(F.max(F.struct("number", "folder")).alias("x")).select("target", "x.folder").collect()  # a row for each target
    return {r["target"]: r["folder"] for r in newest}


def read_target(spark: SparkSession, root: str, target: Target) -> DataFrame:
    """A target's rows as of the last commit."""
    folder = _versions(spark, root).get(target.name)
    return spark.read.schema(target.schema).parquet(f"{root}/rows/{folder}") if folder else spark.createDataFrame([], target.schema)


def read_journal(spark: SparkSession, root: str) -> DataFrame:
    """(batch, target, key, action, old, new) of all commits, values as JSON."""
    batches = [r["batch"] for r in commits(spark, f"{root}/versions").select("batch").collect()]  # one for each commit
    out = spark.createDataFrame([], f"batch string, {_JOURNAL}")
    for b in batches:
        out = out.unionByName(read_table(spark, f"{root}/journal", _JOURNAL, batch=b).withColumn("batch", F.lit(b)))
    return out


def merge_tables(spark: SparkSession, root: str, incoming: list[tuple[Target, DataFrame]], *, batch: str) -> dict[str, dict[str, int]]:
    """Merges rows into each target and commits all of them; the number of inserts and updates of each.  A target
    without a change keeps its version."""
    if committed(spark, f"{root}/versions", batch):
        return {t.name: {"insert": 0, "update": 0} for t, _ in incoming}
    number = commits(spark, f"{root}/versions").count() + 1
    journal, versions, counts = spark.createDataFrame([], _JOURNAL), [], {}
    for target, rows in incoming:
        folder = f"{target.name}-{uuid.uuid4().hex}"
        classify(read_target(spark, root, target), rows, target).write.parquet(f"{root}/staged/{folder}")
        done = spark.read.parquet(f"{root}/staged/{folder}")
        n = {r["action"]: r["n"] for r in done.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts[target.name] = {a: n.get(a, 0) for a in ("insert", "update")}
        if counts[target.name] == {"insert": 0, "update": 0}:
            continue
        done.drop("action", "_old", "_new").write.parquet(f"{root}/rows/{folder}")
        versions.append((batch, target.name, folder, number))
        changed = done.where("action <> 'keep'")
        key = F.to_json(F.struct(*target.key))
        journal = journal.unionByName(changed.select(F.lit(target.name).alias("target"), key.alias("key"), "action", F.col("_old").alias("old"), F.col("_new").alias("new")))
    append_batch(journal, f"{root}/journal", f"{batch}")
    append_batch(spark.createDataFrame(versions, _VERSION).coalesce(1), f"{root}/versions", batch)
    return counts

