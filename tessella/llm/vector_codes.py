"""Vector code compression: product codebooks learned by Yinyang Lloyd rounds in whole numbers.

A vector becomes whole numbers, is cut into equal parts, and each part position has a codebook of a few entries.  The
vectors lie in tiles of a written table: whole numbers, and for each part the entry it is assigned to, an upper bound
of the distance to it and, for each group of the codebook's entries, one lower bound of the distance to the group's
other entries.  A round is one pass over the tiles: bounds move by the drifts of the last update, parts whose upper
bound is below all lower bounds keep their entry without a distance, the others make the upper bound tight and scan
only the groups whose bound fails.  Bounds are doubles, moved outwards by more than their rounding errors before they
are compared, and any part whose bounds could be equal is scanned; a scan compares squared distances as 64-bit
integers, ties to the lower index.  So the codes are those of plain Lloyd rounds, bit for bit.

Each pass writes the new tiles with their sums by entry, which Spark adds up (partial sums first); the driver holds the
codebooks alone: parts * entries * length numbers.  A lost executor recomputes tiles of the table before; that table is
emptied once the next stands, so two copies are on storage at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, own_name, read, release
from .topk_search import usable

#: Fixed values of the query: scale of components, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Groups of a codebook's entries; vectors of a tile at most, and its bytes at most.
GROUPS, TILE, TILE_BYTES = 4, 4096, 4 << 20
#: Relative and absolute slack of bounds, far above what sums and roots of doubles lose.
SLACK = 1e-6

#: A tile: the rows' other columns, whole numbers (of `width` bytes), state, sums by entry, distances taken.
_STATE = "kept array<{0}>, raw binary, width int, assigned binary, upper binary, lower binary, sums array<long>, scanned long"


def group_entries(codebook: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds from entries chosen farthest first.  Any grouping gives right
    codes; near entries in one group make bounds tight."""
    groups = min(groups, len(codebook))
    x = codebook.astype(np.float64)
    picked = [0]
    while len(picked) < groups:
        picked.append(int(((x[:, None] - x[picked]) ** 2).sum(2).min(1).argmax()))
    centres = x[picked]
    for _ in range(5):
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == g].mean(0) if (at == g).any() else centres[g] for g in range(groups)])
    return at


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of points (n, d) and entries (n or 1, d) or of all pairs (n, k) with entries (1, k, d)."""
    diff = points - entries
    return (diff * diff).sum(-1)


class Codebook:
    """One part position's entries, their groups, and how far each entry has moved in the last update."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, moved: np.ndarray):
        self.entries, self.groups, self.moved = entries, groups, moved
        self.n_groups = int(groups.max()) + 1
        self.group_moved = np.array([moved[groups == g].max(initial=0.0) for g in range(self.n_groups)])

    def assign(self, points: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Assigns points (in place: at, upper, lower) and returns how many distances it took.  Before the first
        round `upper` is infinite and `lower` 0, so everything is scanned."""
        upper += self.moved[at] * (1 + SLACK)
        lower -= self.group_moved * (1 + SLACK)
        np.maximum(lower, 0, out=lower)
        outer, inner = upper * (1 + SLACK) + SLACK, lower * (1 - SLACK) - SLACK
        open_ = np.flatnonzero(outer >= inner.min(1))
        if not len(open_):
            return 0
        taken = len(open_)
        best = _squared(points[open_], self.entries[at[open_]])  # the tight upper bound
        upper[open_] = np.sqrt(best.astype(np.float64))
        fails = (upper[open_] * (1 + SLACK) + SLACK)[:, None] >= inner[open_]
        still = fails.any(1)
        open_, best, fails = open_[still], best[still], fails[still]
        taken += int((fails * np.bincount(self.groups, minlength=self.n_groups)).sum())
        if not len(open_):
            return taken
        none = np.iinfo(np.int64).max
        d = np.full((len(open_), len(self.entries)), none)
        for g in range(self.n_groups):
            asked, members = np.flatnonzero(fails[:, g]), np.flatnonzero(self.groups == g)
            if len(asked) and len(members):
                d[asked[:, None], members] = _squared(points[open_[asked], None, :], self.entries[None, members])
        old = at[open_]
        d[np.arange(len(open_)), old] = best
        new = d.argmin(1)  # the first of equal ones: the lower index
        least = d[np.arange(len(open_)), new]
        # a scanned group's bound is its nearest entry other than the new one
        rest = d.copy()
        rest[np.arange(len(open_)), new] = none
        for g in range(self.n_groups):
            members, asked = np.flatnonzero(self.groups == g), fails[:, g]
            if len(members):
                nearest = rest[:, members].min(1)
                # with no other entry in the group the bound can never fail
                lower[open_[asked], g] = np.where(nearest[asked] == none, np.inf, np.sqrt(nearest[asked].astype(np.float64)))
                # the entry just left may be in a group that was not scanned: its distance bounds that group too
                left = ~asked & (self.groups[old] == g) & (new != old)
                lower[open_[left], g] = np.minimum(lower[open_[left], g], np.sqrt(best[left].astype(np.float64)))
        at[open_], upper[open_] = new, np.sqrt(least.astype(np.float64))
        return taken


def _whole(x: np.ndarray, scale: int, dim: int) -> np.ndarray:
    """floor(scale * component) as 64-bit integers, which squared distances of whole vectors must fit."""
    x = np.floor(x.astype(np.float64) * scale)
    largest = float(np.abs(x).max(initial=0))
    if 4 * largest * largest * dim >= 2.0**62:
        raise ValueError(f"squared distances of components times {scale} do not fit 64 bits")
    return x.astype(np.int64)


def _batch(kept: pa.Array, x: np.ndarray, state: list | None, scanned: int, sums: np.ndarray | None) -> pa.RecordBatch:
    """One tile as a row."""
    width = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4 if np.abs(x).max(initial=0) < 1 << 31 else 8
    listed = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
    blobs = [None] * 3 if state is None else [np.ascontiguousarray(a).tobytes() for a in state]
    cells = [
        listed, pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs),
        pa.array([None if sums is None else sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(cells, names=["kept", "raw", "width", "assigned", "upper", "lower", "sums", "scanned"])


def _pack(rows: DataFrame, dim: int, scale: int, state: str) -> DataFrame:
    """rows (kept, v) as tiles in their first state."""

    def pack(batches):
        for batch in batches:
            x = _whole(batch.column(1).flatten().to_numpy(zero_copy_only=False), scale, dim).reshape(batch.num_rows, dim)
            step = max(1, min(TILE, TILE_BYTES // (4 * dim)))
            for a in range(0, batch.num_rows, step):
                yield _batch(batch.column(0).slice(a, step), x[a : a + step], None, 0, None)

    return rows.mapInArrow(pack, state)


def _opened(batch: pa.RecordBatch, r: int, parts: int, dim: int):
    """A tile's rows, whole numbers by part (n, parts, length), assignments, upper and lower bounds."""
    cell = {c: batch.column(c)[r].as_py() for c in ("raw", "width", "assigned", "upper", "lower")}
    x = np.frombuffer(cell["raw"], f"<i{cell['width']}").astype(np.int64).reshape(-1, parts, dim // parts)
    n = len(x)
    kept = batch.column("kept")[r].values
    if cell["assigned"] is None:
        return kept, x, np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts, GROUPS))
    at = np.frombuffer(cell["assigned"], "u1").astype(np.int64).reshape(n, parts)
    upper = np.frombuffer(cell["upper"], "<f4").astype(np.float64).reshape(n, parts)
    lower = np.frombuffer(cell["lower"], "<f4").astype(np.float64).reshape(n, parts, GROUPS)
    return kept, x, at, upper, lower


def _outwards(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as they are stored, in 32 bits: never tighter than they were."""
    up, low = upper.astype("<f4"), lower.astype("<f4")
    up = np.where(up < upper, np.nextafter(up, np.float32(np.inf)), up)
    return up, np.where(low > lower, np.nextafter(low, np.float32(-np.inf)), low)


def _assign(tiles: DataFrame, books: list[Codebook], dim: int, state: str) -> DataFrame:
    """The tiles after one assignment, with the sums and counts of each part position's entries."""
    parts, entries, length = len(books), len(books[0].entries), dim // len(books)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                kept, x, at, upper, lower = _opened(batch, r, parts, dim)
                sums, scanned = np.zeros((parts, entries, length + 1), np.int64), 0
                for p, book in enumerate(books):
                    a, u, low = at[:, p].copy(), upper[:, p].copy(), lower[:, p, : book.n_groups].copy()
                    scanned += book.assign(x[:, p], a, u, low)
                    at[:, p], upper[:, p], lower[:, p, : book.n_groups] = a, u, low
                    np.add.at(sums[p, :, :length], a, x[:, p])
                    sums[p, :, length] = np.bincount(a, minlength=entries)
                yield _batch(kept, x.reshape(len(x), dim), [at.astype("u1"), *_outwards(upper, lower)], scanned, sums)

    return tiles.mapInArrow(run, state)


def learn_codebooks(rows: DataFrame, start: np.ndarray, *, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[Codebook]]:
    """(tiles, codebooks) of rows (kept: a struct, v: array of doubles, all of one length) from codebooks that start
    with whole numbers `start` (entries, parts, length): rounds of assignment and update, then one more assignment.
    An entry without parts stays."""
    entries, parts, length = start.shape
    dim = parts * length
    state = _STATE.format(rows.schema["kept"].dataType.simpleString())
    books = [Codebook(start[:, p], group_entries(start[:, p], GROUPS), np.zeros(entries)) for p in range(parts)]
    held = materialize(_pack(rows.select("kept", "v"), dim, scale, state), "codes-tiles")
    for turn in range(rounds + 1):
        last, held = held, materialize(_assign(held, books, dim, state), "codes-tiles")
        release(last)
        if turn == rounds:
            return held, books
        sums = held.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # as many rows as the codebooks have numbers
        total = np.zeros(parts * entries * (length + 1), np.int64)
        for r in sums:
            total[r["i"]] = r["x"]
        total = total.reshape(parts, entries, length + 1)
        for p, book in enumerate(books):
            n = total[p, :, -1:]
            new = np.where(n > 0, total[p, :, :-1] // np.maximum(n, 1), book.entries)  # goes down, below 0 too
            books[p] = Codebook(new, book.groups, np.sqrt(_squared(new, book.entries).astype(np.float64)))


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in codebooks for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """The rows with a usable vector, without it, with code (two hex digits for each part), error (squared distance to
    the coded vector, in whole numbers) and codebooks_sha256; where a column has such a name, the new one gets an
    underscore.  Codebooks start as the parts of the first `entries` (256 at most) vectors by key, nulls last.

    Rows whose vector is null or holds a null, infinite or undefined component go; so do those whose length `parts`
    doesn't divide or is not that of the first row left.  Repeated rows are vectors of their own (those of one key go
    by their components); a null key is kept; no usable vector gives no rows.  All other columns travel with the tiles:
    select those that are wanted."""
    others = [f for f in rows.schema if f.name != vector]
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    size = F.size("v")
    good = rows.select(F.struct(*(F.col(f"`{f.name}`") for f in others)).alias("kept"), F.when(usable(F.col(f"`{vector}`")), v).alias("v"))
    good = good.where(F.col("v").isNotNull() & (size > 0) & (size % parts == 0))
    first = good.orderBy(F.col("kept")[key].asc_nulls_last(), "v").select("v").limit(entries).collect()
    code, error, sha = (own_name(c, [f.name for f in others]) for c in ("code", "error", "codebooks_sha256"))
    # the columns' own names are put back at the end, whatever they are
    schema = f"kept {good.schema['kept'].dataType.simpleString()}, code string, error long"

    def named(coded: DataFrame, of: str) -> DataFrame:
        return coded.select(*(F.col("kept")[f.name].alias(f.name) for f in others), F.col("code").alias(code), F.col("error").alias(error), F.lit(of).alias(sha))

    if not first:
        return named(rows.sparkSession.createDataFrame([], schema), digest([]))
    dim = len(first[0]["v"])
    start = _whole(np.array([r["v"] for r in first if len(r["v"]) == dim], np.float64), scale, dim).reshape(-1, parts, dim // parts)
    tiles, books = learn_codebooks(good.where(size == dim), start, rounds=rounds, scale=scale)

    def give(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                kept, x, at, _, _ = _opened(batch, r, parts, dim)
                error = sum(_squared(x[:, p], book.entries[at[:, p]]) for p, book in enumerate(books))
                codes = [row.tobytes().hex() for row in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([kept, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["kept", "code", "error"])

    return named(tiles.select("kept", "raw", "width", "assigned", "upper", "lower").mapInArrow(give, schema), digest([b.entries for b in books]))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code, error and summed error of its label for every usable vector; see compress() for nulls and repeats.  Errors
    are summed by label first (partial sums before the shuffle), so a label with most rows is one row of a table."""
    coded = materialize(compress(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")), "codes")
    total = bounded(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql() -> str:
    """Each round's assignment and update in turn; a codebook entry is (p, e, c: components)."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT i, p, e, d, x FROM (SELECT t.i, t.p, b.e, t.x, list_sum(list_transform(list_zip(t.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts t JOIN b{r} b USING (p))
    QUALIFY row_number() OVER (PARTITION BY i, p ORDER BY d, e) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM
    (SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (SELECT p, e, generate_subscripts(x, 1) AS j, unnest(x) AS y FROM a{r}) GROUP BY ALL)) GROUP BY ALL),
  b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return ",\n  ".join(steps)


ORACLE = f"""WITH held AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT i, p, v[(p * len(v) // {PARTS} + 1):((p + 1) * len(v) // {PARTS})] AS x FROM held, (SELECT unnest(range({PARTS})) AS p)),
  b0 AS MATERIALIZED (SELECT p, i - 1 AS e, x AS c FROM parts WHERE i <= {ENTRIES}),
  {_rounds_sql()},
  coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY i),
  hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN held USING (i), hash"""
