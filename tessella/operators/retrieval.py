"""Dense, lexical and fused retrieval over passages.

A top-k is Spark's ordered take for one query and a ranking window per query for many; scores are
expressions in the JVM, but for many-query cosine search, which is products of blocks.  Ties always end at the id, so results are stable.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, tokenize

#: Hits kept, lowest similarity, pool and constant of rank fusion, characters that tell hits apart.
TOP_K, MIN_SCORE, POOL, FUSION, SAME = 12, 0.15, 50, 60, 120
#: BM25 saturation and length weight, the literature's usual ones.
K1, B = 1.5, 0.75
#: Digits to which cosines are ranked.  Lexical scores are whole numbers of 1 / UNIT, so that no order of a sum
#: changes them and equal texts tie.
EXACT, UNIT = 12, 1_000_000_000
#: Bytes of query vectors up to which they are broadcast; queries and bytes of their texts in one lexical search, about.
SMALL_BYTES, QUERIES, QUERY_BYTES = 64 << 20, 10_000, 8 << 20
#: Vectors in a block of many-query search; a product of two blocks is the largest piece of work.
BLOCK = 1024
#: Passages that a lexical search scores at a time.
SLICE = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The vector divided by its length, which counts as 1e-12 at least; nulls in it stay and add nothing to the length."""
    n = F.greatest(norm(F.filter(v, lambda x: x.isNotNull())), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null or zero."""
    return F.try_divide(_dot(a, b), norm(a) * norm(b))


def dense_topk(passages: DataFrame, query: list[float], *, key: str = "vec_id", k: int = TOP_K, min_score: float | None = MIN_SCORE, issues: list | None = None) -> DataFrame:
    """The k passages closest to the query.  Issues filter before the limit; min_score and null
    similarities after it, so fewer than k rows may be left."""
    if issues is not None:
        passages = passages.where(F.col("label").isin(*issues)) if issues else passages.where(F.lit(False))
    scored = passages.withColumn("similarity", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), EXACT))
    top = scored.orderBy(F.col("similarity").desc_nulls_last(), key).limit(k)
    top = top.where(F.col("similarity").isNotNull())
    return top if min_score is None else top.where(F.col("similarity") >= min_score)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) as blocks of at most `size` vectors of one length: (dim, ids, raw), ids ascending and raw the
    doubles in row order.  Vectors that are null, hold a null or have no length have no similarity and are left out."""

    def run(batches):
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            dims = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, size):
                    one = part.slice(at, size)
                    ids = pa.ListArray.from_arrays(pa.array([0, one.num_rows], pa.int32()), one.column(0))
                    raw = one.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), ids, pa.array([raw], pa.binary())], names=["dim", "ids", "raw"])

    v = F.transform("v", lambda x: x.cast("double"))
    held = rows.where(F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (norm(F.col("v")) > 0)).select("id", v.alias("v"))
    return held.mapInArrow(run, f"dim int, ids array<{rows.schema['id'].dataType.simpleString()}>, raw binary")


def batch_topk(passages: DataFrame, queries: DataFrame, *, key: str = "vec_id", k: int = TOP_K) -> DataFrame:
    """(query_id, key, similarity, rank) of the k closest passages for each of many queries (query_id, q).  Both
    sides are packed into blocks of bounded size; a product of two blocks gives the similarities of their pairs and
    leaves k rows per query, so pairs are never rows of a table."""
    asked = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"))
    n, size = asked.agg(F.count(F.lit(1)), F.sum(F.size("v").cast("long") * 8)).first()
    asked = _packed(asked.repartition(max(1, -(-n // BLOCK))), BLOCK).withColumnsRenamed({"ids": "query_ids", "raw": "query_raw"})
    held = _packed(passages.select(F.col(key).alias("id"), F.col("embedding").alias("v")), BLOCK)
    # joined on true: on the length, all blocks would go to one task
    asked = asked.withColumnRenamed("dim", "query_dim")
    pairs = held.join(F.broadcast(asked) if (size or 0) <= SMALL_BYTES else asked, F.lit(True))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                if dim != batch.column("query_dim")[r].as_py():
                    continue
                ids, query_ids = batch.column("ids")[r].values, batch.column("query_ids")[r].values
                e = np.frombuffer(batch.column("raw")[r].as_buffer(), "<f8").reshape(-1, dim)
                q = np.frombuffer(batch.column("query_raw")[r].as_buffer(), "<f8").reshape(-1, dim)
                long = lambda x: np.sqrt((x * x).sum(1))
                s = np.round(q @ e.T / np.outer(long(q), long(e)), EXACT)
                # ids ascend, so a stable order of falling similarities ends ties at the id; NaN is above all
                best = np.argsort(-np.where(np.isnan(s), np.inf, s), axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(at)), ids.take(pa.array(best.ravel())), pa.array(s[at, best.ravel()])], names=["query_id", key, "similarity"])

    kinds = queries.schema["query_id"].dataType.simpleString(), passages.schema[key].dataType.simpleString()
    scored = pairs.mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, similarity double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))
    return scored.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", key, "similarity", "rank")


def bm25(passages: DataFrame, queries: DataFrame, *, key: str, k: int, text: str = "text", tokens=tokenize) -> DataFrame:
    """(query_id, key, score, rank) of the k best passages for each query (query_id, text) by Okapi BM25 with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  A token that a query repeats counts as often.  Passages
    without a token of the query are none of its hits.  A token's part of a score is rounded to a whole number of
    1 / UNIT, and these are added and ranked, ties to the smaller key: the result is one, however work is dealt.

    Queries are a stated set of any size, dealt by id to groups of some QUERIES queries and QUERY_BYTES bytes, which
    are searched one after the other: the words of one group travel with the tasks."""
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    groups = max(1, -(-n // QUERIES), -(-(size or 0) // QUERY_BYTES))
    found = None
    for g in range(groups):
        mine = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        part = _bm25(passages, mine, key=key, k=k, text=text, tokens=tokens)
        found = part if found is None else found.unionByName(part)
    return found


class _Postings:
    """How often each query holds each word, by blocks of BLOCK queries: a part of the matrix of words by queries is
    put together from them without a loop over postings."""

    def __init__(self, words: list[dict[int, int]], n: int):
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        query, times = (np.array([x for w in words for x in part(w)], np.int64) for part in (dict.keys, dict.values))
        self.blocks = []
        for q0 in range(0, n, BLOCK):
            at = np.flatnonzero((query >= q0) & (query < q0 + BLOCK))
            self.blocks.append((q0, min(BLOCK, n - q0), word[at], query[at] - q0, times[at]))

    def matrix(self, block: int, present: np.ndarray) -> np.ndarray:
        """Words `present` (ascending) by the queries of a block."""
        _, width, word, query, times = self.blocks[block]
        a, b = np.searchsorted(word, present), np.searchsorted(word, present, "right")
        row = np.repeat(np.arange(len(present)), b - a)
        at = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        m = np.zeros((len(present), width))
        m[row, query[at]] = times[at]
        return m


def _bm25(passages: DataFrame, queries: DataFrame, *, key: str, k: int, text: str, tokens) -> DataFrame:
    """bm25() of one group of queries.  Two passes over the passages, in Arrow slices: one sums the document
    frequencies of the queries' words, one scores (passages by words times words by queries) and keeps k passages a
    query and task, so no token is ever shuffled."""
    asked = queries.select("query_id", "text").collect()
    words: dict[str, dict[int, int]] = {}
    for q, row in enumerate(asked):
        for t in tokens(row["text"]):
            mine = words.setdefault(t, {})
            mine[q] = mine.get(q, 0) + 1
    number = {t: i for i, t in enumerate(words)}
    ids = pa.array([r["query_id"] for r in asked])

    def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, times, length of each row) of the asked words in texts."""
        row, word, times, length = [], [], [], []
        for i, t in enumerate(texts.to_pylist()):
            found, seen = tokens(t), {}
            length.append(len(found))
            for w in found:
                if (n := number.get(w)) is not None:
                    seen[n] = seen.get(n, 0) + 1
            row += [i] * len(seen)
            word += seen.keys()
            times += seen.values()
        return np.array(row, np.int64), np.array(word, np.int64), np.array(times, np.float64), np.array(length, np.float64)

    def count(batches):
        df, n, total = np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            _, word, _, length = cells(batch.column(0))
            df += np.bincount(word, minlength=len(df))
            n, total = n + len(length), total + int(length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())], names=["word", "n"])

    sums = {r["word"]: r["n"] for r in passages.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n, mean = sums.get(-2, 0), sums.get(-1, 0) / max(sums.get(-2, 0), 1)
    df = np.array([sums.get(i, 0) for i in range(len(words))], np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    postings = _Postings(list(words.values()), len(asked))

    def best(hits: pd.DataFrame) -> pd.DataFrame:
        return hits.sort_values(["q", "score", "key"], ascending=[True, False, True]).groupby("q", sort=False).head(k)

    def score(batches):
        held, kind = [], None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, word, times, length = cells(part.column(1))
                if not len(row):
                    continue
                present, local = np.unique(word, return_inverse=True)
                w = np.zeros((part.num_rows, len(present)))
                w[row, local] = np.round(UNIT * (idf[word] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[row] / mean))))
                for block, (q0, *_) in enumerate(postings.blocks):
                    s = w @ postings.matrix(block, present)  # whole numbers below 2 ** 53, so exact
                    r, q = np.nonzero(s)
                    keys = part.column(0).take(pa.array(r)).to_pandas()
                    held.append(best(pd.DataFrame({"q": q + q0, "score": s[r, q], "key": keys})))
            if held:
                held = [best(pd.concat(held))]
        if held:
            h = held[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(h["q"].to_numpy())), pa.array(h["key"], kind), pa.array(h["score"].to_numpy().astype(np.int64))], names=["query_id", key, "score"])

    kinds = queries.schema["query_id"].dataType.simpleString(), passages.schema[key].dataType.simpleString()
    scored = passages.select(key, text).mapInArrow(score, f"query_id {kinds[0]}, {key} {kinds[1]}, score long")
    place = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    top = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return top.withColumn("score", F.col("score") / UNIT)


def fuse(first: DataFrame, second: DataFrame, *, key: str, top: int, constant: int = FUSION) -> DataFrame:
    """(query_id, key, score) by reciprocal ranks 1 / (constant + rank) of two rankings (query_id, key, rank
    from 1), the `top` best; ties go by the rank in the first, then in the second."""
    a = first.select("query_id", key, F.col("rank").alias("ra"))
    b = second.select("query_id", key, F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("ra") + part("rb"))
    place = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), key)
    return both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).select("query_id", key, "score", "place")


def merge_hits(hits: DataFrame, *, group: list[str], key: str, text: str = "text", k: int = TOP_K) -> DataFrame:
    """Hits of several searches as one: the best of those that begin alike, the k best of these."""
    best = hits.groupBy(*group, F.substring(text, 1, SAME).alias("_same")).agg(F.max(F.struct("similarity", (-F.col(key)).alias("_low"))).alias("x"))
    best = best.select(*group, F.col("x.similarity").alias("similarity"), (-F.col("x._low")).alias(key))
    place = W.partitionBy(*group).orderBy(F.col("similarity").desc(), key)
    return best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def by_authority(hits: DataFrame, group: list[str], line: Column) -> DataFrame:
    """Lines of binding, persuasive and reference hits, in order of rank; other hits are left out and an
    empty bucket says (none)."""
    def bucket(name: str) -> Column:
        some = F.array_sort(F.collect_list(F.when(F.col("authority") == name, F.struct("rank", line.alias("line")))))
        return F.coalesce(F.nullif(F.array_join(F.transform(some, lambda x: x["line"]), "\n"), F.lit("")), F.lit("(none)")).alias(name)

    return hits.groupBy(*group).agg(*map(bucket, ("binding", "persuasive", "reference")))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


#: Characters of a passage in a context line, and of an attached document.
LINE, ATTACHED = 200, 8000


def assemble_hits(found: DataFrame) -> DataFrame:
    """found (content, metadata: map of texts, similarity) with hit: the metadata with content and similarity in it,
    which stand before metadata of these names."""
    own = F.create_map(F.lit("content"), F.col("content"), F.lit("similarity"), F.col("similarity").cast("string"))
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("content", "similarity"))
    return found.withColumn("hit", F.map_concat(rest, own))


def context_line(cite: Column, content: Column) -> Column:
    """How a hit is quoted: - cite: the first characters of its content."""
    return F.concat(F.lit("- "), cite, F.lit(": "), F.substring(F.coalesce(content, F.lit("")), 1, LINE))


def attached(document: Column) -> Column:
    """The attached document as far as it is quoted; empty if there is none."""
    return F.substring(strip(F.coalesce(document, F.lit(""))), 1, ATTACHED)


def mean_overlap(first: DataFrame, second: DataFrame, *, key: str, k: int = 5) -> DataFrame:
    """mean_jaccard, over queries, of the k best of two rankings (query_id, key, rank); one row."""
    a, b = (r.where(F.col("rank") <= k).select("query_id", key).distinct() for r in (first, second))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["query_id", key], "full_outer")
    each = both.groupBy("query_id").agg((F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)) / F.count(F.lit(1))).alias("j"))
    return each.agg(F.avg("j").alias("mean_jaccard"))


def judged(samples: DataFrame, judge, metrics: list[str]) -> DataFrame:
    """(config, mode) and the mean of each metric, to three digits, of samples (config, mode, question, contexts,
    reference) as the judge (a function of the last three, to a dictionary) rates them; what it leaves out is not
    counted."""

    def run(frames):
        for f in frames:
            rated = [judge(*row) for row in f[["question", "contexts", "reference"]].itertuples(index=False)]
            yield pd.DataFrame({"config": f["config"], "mode": f["mode"], **{m: [r.get(m) for r in rated] for m in metrics}})

    schema = f"config {samples.schema['config'].dataType.simpleString()}, mode {samples.schema['mode'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in metrics)
    rated = samples.select("config", "mode", "question", "contexts", "reference").mapInPandas(run, schema)
    return rated.groupBy("config", "mode").agg(*(F.round(F.avg(m), 3).alias(m) for m in metrics))


def answer_hits(search, query: str, rewrite) -> tuple[DataFrame, str, int]:
    """The retrieval loop on the driver: search, grade the best hit, rewrite the query once if it is weak,
    and merge.  search(query) gives hits (id, similarity, text); rewrite(query) the new query.  Returns
    (hits, route, rewrites)."""
    from ..functions.scalars import MAX_REWRITES, WEAK

    hits, rewrites = search(query), 0
    while True:
        top = hits.agg(F.max("similarity")).first()[0] or 0.0
        if top >= WEAK or rewrites >= MAX_REWRITES:
            return hits, "generate", rewrites
        rewrites += 1
        new = rewrite(query)
        if new != query:
            query = new
            more = hits.unionByName(search(query)).withColumn("_g", F.lit(0))
            hits = merge_hits(more, group=["_g"], key="id").join(more.drop("_g", "similarity").dropDuplicates(["id"]), "id").drop("_g", "place")


def answer_all(questions: DataFrame, search, rewrite, *, checkpoint=lambda df: df) -> DataFrame:
    """The retrieval loop for all questions (query_id, query) at once: (query_id, id, similarity, place, rewrites), a
    row for each of a question's hits; one without hits has a row with a null id.

    search(questions) gives (query_id, id, similarity, content), the best TOP_K of each question; rewrite(query) is a
    Column, the new query.  Questions whose best hit is below WEAK are searched once more under their new query, those
    alone; one whose query stays the same and that has hits keeps these without a search.  Hits of both rounds are
    merged: the best of those that begin alike (first SAME characters), TOP_K at most.  checkpoint() is given each
    round's hits and may write them, so that a search runs once."""
    from ..functions.scalars import WEAK

    first = checkpoint(search(questions))
    top = F.coalesce(F.max("similarity"), F.lit(0.0))
    best = questions.join(first.groupBy("query_id").agg(top.alias("_top"), F.count(F.lit(1)).alias("_n")), "query_id", "left")
    weak = best.where(F.coalesce("_top", F.lit(0.0)) < WEAK).withColumn("_new", rewrite(F.col("query")))
    again = weak.where(~F.col("_new").eqNullSafe(F.col("query")) | F.col("_n").isNull()).select("query_id", F.coalesce("_new", "query").alias("query"))
    second = checkpoint(search(again))
    retried = again.select("query_id").withColumn("_again", F.lit(True))
    found = first.withColumn("_again", F.lit(False)).unionByName(second.withColumn("_again", F.lit(True)))
    merged = merge_hits(found.join(retried.select("query_id"), "query_id", "left_semi"), group=["query_id"], key="id", text="content").select("query_id", "id", "similarity", "place")
    kept = first.join(retried.select("query_id"), "query_id", "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    kept = kept.select("query_id", "id", "similarity", place.alias("place"))
    state = questions.select("query_id").join(weak.select("query_id").withColumn("_weak", F.lit(1)), "query_id", "left")
    state = state.select("query_id", F.coalesce("_weak", F.lit(0)).alias("rewrites"))
    return state.join(merged.unionByName(kept), "query_id", "left").select("query_id", "id", "similarity", "place", "rewrites")
