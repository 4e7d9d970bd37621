"""Exact top-k search by tiled matrix products.

Vectors become whole-number vectors and are packed into tiles of bounded bytes.  A task multiplies its shard's tiles by
the tiles of queries, selects k of each product's columns for every query, and keeps one list of k for each query over
all its tiles; the lists of tasks are then merged as a tree, FAN lists of a query at a time.  So no pair of vectors is
ever a row, what is shuffled is k rows for each query and task, and no key of the data decides where work goes: equal
vectors, however many, are dealt like any others.

Queries are a stated set.  They are searched in groups of GROUP_BYTES at most, each broadcast to a pass over all rows;
one group holds some 100,000 queries, and a larger set takes more passes, each of which ends in a written table.

Whole numbers are multiplied in double precision where no sum can reach 2 ** 53 and as 64-bit integers elsewhere, so
every score is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read, release

#: Fixed values of the query: scale of components, share of query rows, list length.
SCALE, EVERY, TOP = 1024, 100, 10
#: Vectors of a tile at most and its bytes at most, bytes of the queries of a pass, lists merged at a time.
TILE, TILE_BYTES, GROUP_BYTES, FAN = 1024, 1 << 20, 64 << 20, 64
#: No component is larger, so that a product of two fits 62 bits.
LARGEST = 1 << 31

_TILES = "tile_dim int, ids array<long>, raw binary"


def usable(v) -> F.Column:
    """Whether a vector takes part: not null, no null, infinite or undefined component."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, good), F.lit(False))


def whole_numbers(batch: pa.RecordBatch, scale: int):
    """For each length of vectors in a batch (id, vector): (length, ids, floor(scale * component) as 64-bit integers)."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == dim))
        x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if x.size and np.abs(x).max() >= LARGEST:
            raise ValueError(f"components times {scale} must stay below {LARGEST}")
        yield int(dim), part.column(0), x.astype(np.int64).reshape(part.num_rows, int(dim))


def tiles(rows: DataFrame, *, scale: int) -> DataFrame:
    """rows (id, v) as tiles (tile_dim, ids, raw): vectors of one length, ids ascending, raw 32-bit integers by row."""

    def pack(batches):
        for batch in batches:
            for dim, ids, x in whole_numbers(batch, scale):
                order = np.argsort(ids.to_numpy(), kind="stable")
                ids, x = ids.to_numpy()[order], x[order].astype("<i4")
                step = max(1, min(TILE, TILE_BYTES // max(4 * dim, 1)))
                for at in range(0, len(ids), step):
                    one = pa.array([ids[at : at + step].tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), one, pa.array([x[at : at + step].tobytes()], pa.binary())], names=["tile_dim", "ids", "raw"])

    held = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    return held.mapInArrow(pack, _TILES)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, a row for each query."""
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    if largest < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if largest >= 1 << 62:
        raise ValueError("inner products do not fit 64 bits")
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def select(s: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in s, score) of each row's k largest scores, equal ones by smaller id, without places where `own`
    is set.  Partial selection: all above the k-th largest, and of those equal to it the smallest ids."""
    least = np.iinfo(np.int64).min
    s = np.where(own, least, s)
    good = s > least
    if s.shape[1] > k:
        good &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    query, place = np.nonzero(good)
    score = s[query, place]
    order = np.lexsort((ids[query, place] if ids.ndim == 2 else ids[place], -score, query))
    query, place, score = query[order], place[order], score[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], place[first], score[first]


class Lists:
    """The best k of one tile of queries so far."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), np.iinfo(np.int64).min)
        self.ids = np.zeros((len(query_ids), k), np.int64)

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a tile: what it selects is merged with what is held."""
        own = self.query_ids[:, None] == ids[None, :]
        query, place, score = select(s, ids, own, self.k)
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        new_score, new_ids = np.full_like(self.score, np.iinfo(np.int64).min), np.zeros_like(self.ids)
        new_score[query, nth], new_ids[query, nth] = score, ids[place]
        both, both_ids = np.hstack([self.score, new_score]), np.hstack([self.ids, new_ids])
        query, place, score = select(both, both_ids, np.zeros(both.shape, bool), self.k)
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        self.score[:], self.ids[:] = np.iinfo(np.int64).min, 0
        self.score[query, nth], self.ids[query, nth] = score, both_ids[query, place]


def _search(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, query_id, task, vec_id, score): the k best of each query among the tiles that a task reads."""

    def run(batches):
        lists: dict[int, Lists] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim, number = batch.column("tile_dim")[r].as_py(), batch.column("query_tile")[r].as_py()
                q = np.frombuffer(batch.column("query_raw")[r].as_buffer(), "<i4").reshape(-1, dim)
                x = np.frombuffer(batch.column("raw")[r].as_buffer(), "<i4").reshape(-1, dim)
                if number not in lists:
                    lists[number] = Lists(batch.column("query_ids")[r].values.to_numpy().copy(), k)
                lists[number].add(scores(q, x), batch.column("ids")[r].values.to_numpy())
        task = TaskContext.get().partitionId()
        for number, one in lists.items():
            query, nth = np.nonzero(one.score > np.iinfo(np.int64).min)
            numbers = number * TILE + query
            cells = [numbers, one.query_ids[query], np.full(len(query), task), one.ids[query, nth], one.score[query, nth]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["query", "query_id", "task", "vec_id", "score"])

    pairs = held.where("tile_dim > 0").join(F.broadcast(asked), "tile_dim")
    return pairs.select("tile_dim", "ids", "raw", "query_tile", "query_ids", "query_raw").mapInArrow(run, "query long, query_id long, task long, vec_id long, score long")


def exact_topk(rows: DataFrame, queries: DataFrame, *, k: int = TOP, scale: int = SCALE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (id, v) the k rows (id, v) with the largest inner
    product of floor(scale * component), ties to the smaller id; fewer where there are fewer.

    Rows with the query's id are its own and no candidates.  Vectors that are null or hold a null, infinite or undefined
    component take no part, nor do rows without an id; vectors of different lengths have no product, and those of
    length 0 none at all.  Repeated rows are candidates of their own, and a repeated query has a list for each of its
    rows; empty tables give no rows.  Further columns do not enter.
    """
    asked = queries.select("id", "v")
    size = asked.agg(F.sum(F.size("v").cast("long") * 4 + 8)).first()[0] or 0
    # round robin, so tiles are full wherever the queries lay
    asked = materialize(tiles(asked.repartition(max(1, -(-size // TILE_BYTES))), scale=scale), "topk-query-tiles")
    asked = asked.select("tile_dim", F.col("ids").alias("query_ids"), F.col("raw").alias("query_raw"), F.monotonically_increasing_id().alias("query_tile"))
    numbered = materialize(asked, "topk-queries")
    groups = max(1, -(-size // group_bytes))
    held = tiles(rows.select("id", "v"), scale=scale)
    found = None
    for g in range(groups):
        part = numbered.where(F.pmod(F.xxhash64("query_tile"), F.lit(groups)) == g) if groups > 1 else numbered
        lists = materialize(_search(held, part, k), "topk-lists")
        found = lists if found is None else found.unionByName(lists)
    release(numbered)
    for level in (F.floor(F.col("task") / FAN), F.lit(0).cast("long")):
        found = found.withColumn("task", level)
        place = F.row_number().over(W.partitionBy("query", "task").orderBy(F.col("score").desc(), "vec_id"))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best rows for every vec_id divisible by 100; see exact_topk() for nulls, ties and repeats."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return exact_topk(rows, rows.where(F.col("id") % EVERY == 0))


ORACLE = f"""WITH held AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (SELECT q.row, q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM held q JOIN held e ON q.vec_id % {EVERY} = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {TOP}"""
