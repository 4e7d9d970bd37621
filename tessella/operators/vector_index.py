"""An inverted-file index over passage vectors: cells, coded residuals, and exact scores for the best.

Cells are learned by k-means from a bounded sample (the SAMPLE vectors whose keys have the smallest hash) and every
vector is assigned to its nearest one.  The index is Parquet partitioned by cell: a vector's residual from its cell
takes one byte a component, beside its key; the full vectors lie in a second table, and only those of candidates are
read.  A search probes some cells for each query, scores their codes in blocks, keeps `factor` times k candidates a
query, and ranks these by their exact cosines.  How many cells are probed is measured at building time, on the sample:
the fewest that hold RECALL of the true neighbours there.

A cell with more than PART vectors is cut into parts, each with its queries a task of its own, so a cell that holds a
third of all vectors (equal ones, for instance) is no single task.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import TOP_K, cosine, norm

#: Vectors that cells are learned from and probes measured on; cells at most; vectors of a part of a cell.
SAMPLE, MAX_CELLS, PART = 20_000, 1024, 20_000
#: Share of true neighbours that the probed cells must hold on the sample, and neighbours of a sample query.
RECALL, NEIGHBOURS = 0.97, 10
#: Candidates for each hit, ranked exactly.
FACTOR = 5
#: Rounds of k-means.
ROUNDS = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def learn_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres (unit length) of spherical k-means; they start from evenly spaced vectors, and a cell that empties
    takes the vector that is worst placed."""
    x = _unit(sample.astype(np.float64))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        s = x @ centres.T
        at = s.argmax(1)
        worst = iter(np.argsort(s[np.arange(len(x)), at], kind="stable"))
        for c in range(cells):
            mine = x[at == c]
            centres[c] = mine.sum(0) if len(mine) else x[next(worst)]
        centres = _unit(centres)
    return centres


def measure_probes(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL) -> int:
    """The fewest cells that hold `recall` of the nearest neighbours of every 20th sample vector, the sample searched
    whole."""
    x = _unit(sample.astype(np.float64))
    queries = np.arange(0, len(x), max(1, min(20, len(x) // 50)))
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(x) - 1)]
    cell = (x @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(x[queries] @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    wanted = np.sort(place[np.arange(len(queries))[:, None], cell[near]].ravel())
    return int(wanted[min(len(wanted) - 1, int(np.ceil(recall * len(wanted))))]) + 1 if len(wanted) else len(centres)


def _usable(rows: DataFrame) -> DataFrame:
    """rows (id, v) with a vector that has a length: the others have no similarity."""
    v = F.transform("v", lambda x: x.cast("double"))
    good = rows.where(F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    return good.select("id", v.alias("v")).where(norm(F.col("v")) > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(passages: DataFrame, path: str, *, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> None:
    """Writes the index of passages to the folder `path`: tables `cells`, `codes` (partitioned by cell) and `vectors`.
    Vectors of another length than the sample's first are an error; those that are null, hold a null or have no length
    aren't indexed."""
    spark = passages.sparkSession
    rows = _usable(passages.select(F.col(key).alias("id"), F.col(vector).alias("v")))
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    n = rows.count()
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])
    dim = sample.shape[1] if n else 0
    cells = max(1, min(cells or int(n**0.5), MAX_CELLS, len(sample) // 4 or 1))
    centres = learn_cells(sample, cells) if n else np.zeros((1, 0))
    probes = measure_probes(sample, centres) if n else 1
    meta = json.dumps({"dim": dim, "probes": probes, "key": rows.schema["id"].dataType.simpleString()})
    table = [(i, c.tolist(), meta) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if set(batch.column(1).value_lengths().to_pylist()) != {dim}:
                raise ValueError(f"vectors of another length than {dim}")
            x = _unit(_matrix(batch.column(1), dim))
            at = (x @ centres.T).argmax(1)
            rest = x - centres[at]
            step = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.round(rest / step[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(step), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "step", "code"])

    coded = rows.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, cell int, step double, code binary")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # one row a cell
    part = F.pmod(F.xxhash64("id", "code"), F.col("parts")).cast("int")
    coded = coded.join(F.broadcast(sizes), "cell").withColumn("part", part).drop("parts")
    coded.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")


def open_index(spark: SparkSession, path: str) -> tuple[np.ndarray, dict]:
    """(centres, what was measured) of an index."""
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS rows at most
    return np.array([r["centre"] for r in table]), json.loads(table[0]["meta"])


def search_index(spark: SparkSession, path: str, queries: DataFrame, *, k: int = TOP_K, probes: int | None = None, factor: int = FACTOR) -> DataFrame:
    """(query_id, id, similarity, rank): about the k closest indexed vectors of each query (query_id, q), similarities
    exact, ties to the smaller id.  A query without a usable vector has no hits."""
    centres, meta = open_index(spark, path)
    dim, keep = meta["dim"], k * factor
    probes = min(probes or meta["probes"], len(centres))
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = _usable(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"))).where(F.size("v") == dim)

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                s = _matrix(batch.column(1), dim) @ centres.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(best.ravel(), pa.int32())], names=["query_id", "q", "cell"])

    probed = asked.mapInArrow(probe, f"query_id {kind}, q array<double>, cell int")
    wanted = [r[0] for r in probed.select("cell").distinct().collect()]  # cells, not rows
    schema = f"id {meta['key']}, step double, code binary, part int, cell int"
    codes = spark.read.schema(schema).parquet(f"{path}/codes").where(F.col("cell").isin(wanted))  # prunes the folders of other cells
    parts = codes.select(F.col("cell").alias("_cell"), F.col("part").alias("_part")).distinct()
    probed = probed.join(F.broadcast(parts), F.col("cell") == F.col("_cell")).select("query_id", "q", F.col("_cell").alias("cell"), F.col("_part").alias("part"))

    def score(group, held: pa.Table, queries: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(held["code"].to_pylist()), np.int8).reshape(-1, dim) * held["step"].to_numpy()[:, None] + centres[group[0].as_py()]
        q = _unit(_matrix(queries["q"].combine_chunks(), dim))
        out = []
        for a in range(0, len(q), 256):  # a block of products at a time
            s = q[a : a + 256] @ x.T
            best = np.argpartition(-s, min(keep, s.shape[1]) - 1, axis=1)[:, :keep]
            row = np.repeat(np.arange(len(best)), best.shape[1])
            out.append(pa.table({"query_id": queries["query_id"].take(pa.array(row + a)), "id": held["id"].take(pa.array(best.ravel())), "about": s[row, best.ravel()]}))
        return pa.concat_tables(out)

    pairs = codes.groupBy("cell", "part").cogroup(probed.groupBy("cell", "part"))
    about = pairs.applyInArrow(_where_both(score), f"query_id {kind}, id {meta['key']}, about double")
    place = W.partitionBy("query_id").orderBy(F.col("about").desc(), "id")
    near = about.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= keep).select("query_id", "id")
    vectors = spark.read.parquet(f"{path}/vectors")
    exact = near.join(vectors, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = exact.select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 12).alias("similarity")).distinct()
    rank = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return exact.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _where_both(score):
    """score of groups that have both vectors and queries."""

    def run(group, held: pa.Table, queries: pa.Table) -> pa.Table:
        if held.num_rows and queries.num_rows:
            return score(group, held, queries)
        return pa.table({"query_id": queries["query_id"].slice(0, 0), "id": held["id"].slice(0, 0), "about": pa.array([], pa.float64())})

    return run
