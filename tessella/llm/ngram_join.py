"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

Two documents link when their shingle sets overlap enough (100 i >= T u, of intersection and union).  The
result is exact, and no step makes a row for each pair:

1. Documents with equal sets (by 128 bits of hash) are one class; only classes are compared.
2. A linked pair of sets, the smaller of size n, differs in at most k = n (100 - T) / T members.  Members are
   dealt to parts by hash, a few to a part, so at most k parts differ: of the first k + 1 parts of either set
   that aren't empty, one is equal.  Equal parts are the columns of the incidence.  As a part has several
   n-grams, texts that share single n-grams by chance share no column.  Small sets, and all below a
   similarity of about 0.85, have the first |s| - ceil(T |s| / 100) + 1 single n-grams as columns, in an order
   that puts those last that many sets have (by a count sketch of fixed size).  A set with fewer than k + 1
   parts that aren't empty (about one in 10**5) is joined by single n-grams with all others.
3. Columns are gathered by their leading class (the smallest of a column's classes), so that columns with
   the same documents become one block.  A product of a block's rows discards pairs by the size-derived bound:
   the overlap can't reach its minimum if parity bitmaps of the two sets differ in more bits than their
   symmetric difference may have members.  A product returns a spanning forest of the pairs that are left.
4. The forests' components hold every link.  Their sets (and no others) are built again and multiplied,
   exactly; each product returns a spanning forest of its links.  Components of these are the result.

Groups of more than BLOCK rows (in 3: blocks, in 4: components) are multiplied in two passes.  First all rows
meet the PIVOTS rows with the most popular columns, of a group of near copies those closest to all others.
What this connects with the first of these is connected for good: such rows need not meet each other again, only
the others, and these all.  So a group of m near copies, s of them off that part,
costs m / BLOCK times (PIVOTS + s) rows.  Where THIN blocks or more are off that part, a group is parted anew before its
pairs meet: rows stay together only if they share one of their rarest n-grams (by the group's own counts), of as
many as a partner may lack and one more.  Pages of one template whose own part is larger than that part ways; only
those closer to each other, but not linked, still meet in all pairs.  Products are bounded in rows and in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textcore as tc
from .common import bounded, materialize, read, release, row_key
from .components import components

#: Counters of the sketch (fixed, whatever the corpus), in slices that are summed on their own.
SKETCH, SLICES, FAN_IN = 1 << 20, 32, 64
#: Rows of a block, and bytes of a block's bitmaps or sets (unless a single one has more); a product has two blocks.
BLOCK, BLOCK_BYTES = 384, 16 << 20
#: Rows that all others of a large group meet first.
PIVOTS = 32
#: Blocks off the main part from which a group is parted anew: below, all pairs cost less than its rows' n-grams.
THIN = 16
#: The side of the first pivot in a product.
TOP = 3
STEP_BYTES, STEP_ROWS = 6_000_000, 4096
#: Sets below this size have single n-grams as columns.
SMALL = 64
#: n-grams of sets without enough parts that travel with a task, and classes in clusters that are broadcast (32
#: bytes each) to find their texts; beyond that all single n-grams are joined, and the texts are shuffled.
MAX_WANTED = 1_000_000


def least_overlap(a, b, percent: int):
    """The smallest intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the hashes of each row's n-word shingles, repeats included, and where a row's begin."""
    raw, off, _ = tc.column_bytes(column)
    words, first = tc.word_hashes(tc.LOWER[raw], off)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    h = tc.window_hashes(words, n)
    inside = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = h[inside], row[: len(h)][inside]
    short = np.flatnonzero((count > 0) & (count < n))  # the whole sequence is the one shingle
    if len(short):
        own = [tc.mix(tc.window_hashes(words[first[i] : first[i + 1]], int(count[i])) + np.uint64(count[i]))[0] for i in short]
        h, owner = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.searchsorted(owner, np.arange(len(count) + 1))


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set; 0 for the empty one."""
    one, two = np.add.reduce(tc.mix(s ^ np.uint64(0x9E3779B97F4A7C15))), np.add.reduce(tc.mix(s + np.uint64(0x2545F4914F6CDD1D)))
    return (int(one.view(np.int64)), int(two.view(np.int64))) if len(s) else (0, 0)


def _sum_counts(parts: DataFrame, n_parts: int) -> np.ndarray:
    """Sums (slice, part, counts) over parts, FAN_IN of them at a time, and collects the sums: a table of
    fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SLICES, np.int64)
        for v in table.column("counts"):
            total += np.frombuffer(v.as_py(), np.int64)
        return pa.table({"slice": table.column("slice")[:1].combine_chunks(), "part": table.column("part")[:1].combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = parts.groupBy("slice", "part").applyInArrow(add, "slice int, part int, counts binary")
        n_parts = -(-n_parts // FAN_IN)
        if n_parts <= 1:
            break
    out = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for r in parts.collect():
        out[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def frequency_classes(docs: DataFrame, n: int, every: bool) -> np.ndarray:
    """A class for each counter of a sketch of the small texts' n-grams (or every text's): 0 up to twice the mean count, then one more for each doubling."""

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                h, first = shingles(part.column(1), n)
                h = h[np.repeat(every | (np.diff(first) < 2 * SMALL), np.diff(first))]
                total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                at = part.column(0)[0].as_py()
        if total.any():
            for i, counts in enumerate(total.reshape(SLICES, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["slice", "part", "counts"])

    parts = docs.select(F.spark_partition_id().alias("part"), "text").mapInArrow(run, "slice int, part int, counts binary")
    counts = _sum_counts(parts, docs.rdd.getNumPartitions())
    mean = max(counts.mean(), 1.0)
    return np.maximum(np.floor(np.log2(np.maximum(counts, 1) / mean)), 0).astype(np.uint8)


def _bits(n: int) -> int:
    """log2 of the bitmap's length for a set of n: a bit a member at least, 64 at least."""
    return max(6, int(n - 1).bit_length())


def bitmap(members: np.ndarray) -> bytes:
    """Parity of the number of members in each of 2**k cells: of two sets' bitmaps, at most as many bits
    differ as the symmetric difference has members."""
    size = 1 << _bits(len(members))
    cell = (tc.mix(members) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(n: int, percent: int) -> int:
    """How many members two linked sets, the smaller of size n or less, may differ in."""
    return n * (100 - percent) // percent


def part_shift(percent: int) -> int | None:
    """A set of n is dealt to 2 ** (floor(log2 n) - shift) parts: the largest shift that leaves enough parts
    filled; None if that leaves parts of one or two members, which tell no more than single ones."""
    share, found = 1.05 * (100 - percent) / percent, None
    for shift in range(1, 4):
        most = 2.0 ** (shift + 1)  # members a part, at most
        if (1 - np.exp(-most)) / most >= share:
            found = shift
    return found


def singles(s: np.ndarray, percent: int, classes: np.ndarray | None) -> np.ndarray:
    """The first |s| - ceil(T |s| / 100) + 1 members in the common order: linked sets share one of them."""
    most = len(s) + percent * len(s) // -100 + 1
    if classes is not None:
        level = classes[(s >> np.uint64(44)).astype(np.int64)]
        if level.any():
            return s[np.argsort(level, kind="stable")[:most]]
    return s[:most]


def columns_of(s: np.ndarray, percent: int, shift: int | None, classes: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, bool]:
    """(columns, short): hashes of the first filled parts of a sorted set, for each number of parts under which
    it may meet a partner (its own as the smaller, its partner's as the larger); short if there are too few."""
    n = len(s)
    if shift is None or n < small:
        return singles(s, percent, classes), False
    least = -(-percent * n // 100)
    out, short = [], False
    where = tc.mix(s ^ np.uint64(0xA0761D6478BD642F))
    value = tc.mix(s + np.uint64(0xE7037ED1A0B428DB))
    for level in range(n.bit_length() - 1, max(least, small).bit_length() - 2, -1):
        most = differing(min(n, (2 << level) - 1), percent) + 1
        part = where >> np.uint64(64 - (level - shift)) if level > shift else np.zeros(n, np.uint64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        short |= len(begin) < most
        total = np.add.reduceat(value[order], begin)[:most]
        out.append(tc.mix(total ^ tc.mix(part[begin[:most]] + np.uint64(level << 48))))
    if least < small:
        out.append(singles(s, percent, classes))
    return np.concatenate(out), short


def incidence(docs: DataFrame, n: int, percent: int, classes: np.ndarray, small: int) -> DataFrame:
    """(doc_id, _row, n, k1, k2, grams, short, bits) of each row: size, 128-bit hash, columns and bitmap of its set."""
    shift = part_shift(percent)

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                h, first = shingles(part.column(1), n)
                size, k1, k2, grams, short, bits = [], [], [], [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    s = np.unique(h[a:b])
                    size.append(len(s))
                    one, two = set_keys(s)
                    k1.append(one)
                    k2.append(two)
                    found, few = columns_of(s, percent, shift, classes, small) if len(s) else (s, False)
                    grams.append(found.view(np.int64))
                    short.append(few)
                    bits.append(bitmap(s) if len(s) else b"")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in grams])]), pa.int32()), pa.array(np.concatenate(grams) if grams else [], pa.int64()))
                columns = [part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists, pa.array(short, pa.bool_()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "n", "k1", "k2", "grams", "short", "bits"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key(F.col("text"))).mapInArrow(run, f"doc_id {id_type}, _row long, n long, k1 long, k2 long, grams array<long>, short boolean, bits binary")


def single_cells(docs: DataFrame, n: int, percent: int, wanted: np.ndarray | None) -> DataFrame:
    """(k1, k2, gram): single-member columns of each row's set, of the sorted wanted ones only, if given."""

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 0, STEP_BYTES, STEP_ROWS):
                h, first = shingles(part.column(0), n)
                keys, more, grams = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    s = np.unique(h[a:b])
                    if len(s):
                        g = singles(s, percent, None).view(np.int64)
                        if wanted is not None:
                            g = g[np.isin(g, wanted)]
                        k1, k2 = set_keys(s)
                        keys += [k1] * len(g)
                        more += [k2] * len(g)
                        grams.append(g)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(more, pa.int64()), pa.array(np.concatenate(grams) if grams else [], pa.int64())], names=["k1", "k2", "gram"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, gram long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        a = 0
        for b in np.flatnonzero(new).tolist():
            held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches([x for x in held if x.num_rows])
            held, a = [], b
        held.append(batch.slice(a))
    if held:
        yield pa.Table.from_batches(held)


def _fold(x: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at half their length."""
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


class _Forest:
    """Trees over the rows of a product: which rows are connected, and the edges that did it."""

    def __init__(self, n: int):
        self.tree, self.edges = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        """Row i is linked with each of the others; one of each tree gives an edge."""
        trees, at = np.unique(self.tree[others], return_index=True)
        new = trees != self.tree[i]
        self.edges += [(i, j) for j in others[at[new]].tolist()]
        if new.any():
            self.tree[np.isin(self.tree, trees[new])] = self.tree[i]


def _partners(sizes: np.ndarray, side: np.ndarray, forest: _Forest, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows) of the product's pairs, with sizes in ascending order: later rows j to whose size the overlap can
    rise, which i meets (rows of one side, unless it is 0, meet in another product) and isn't connected with yet."""
    last = np.searchsorted(sizes, sizes * 100 // percent, "right")
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, last[i])
        meet = (side[j] == 0) | (side[j] != side[i])
        j = j[meet & (forest.tree[j] != forest.tree[i])]
        if len(j):
            yield i, j


def possible_links(sizes: np.ndarray, side: np.ndarray, bits: list[np.ndarray], percent: int) -> _Forest:
    """A spanning forest of the product's pairs whose bitmaps (64-bit words) allow a link; sizes ascend."""
    words = np.array([len(b) for b in bits])
    begin = {int(w): int(np.searchsorted(words, w)) for w in np.unique(words)}  # longer sets have longer bitmaps
    own = {w: np.stack(bits[a : int(np.searchsorted(words, w, "right"))]) for w, a in begin.items()}
    half = {w: _fold(x) for w, x in own.items() if w > 1}
    forest = _Forest(len(sizes))
    for i, j in _partners(sizes, side, forest, percent):
        w = int(words[i])
        most = sizes[i] + sizes[j] - 2 * least_overlap(sizes[i], sizes[j], percent)
        mine, hit = own[w][i - begin[w]], np.zeros(len(j), bool)
        for width, table in ((w, own), (2 * w, half)):  # a partner's bitmap is as long or twice as long
            some = words[j] == width
            if some.any():
                hit[some] = np.bitwise_count(table[width][j[some] - begin[width]] ^ mine).sum(axis=1, dtype=np.int64) <= most[some]
        forest.join(i, j[hit])
    return forest


def linked_pairs(sizes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> _Forest:
    """A spanning forest of the product's links; sizes ascend.  Overlaps are a row of the incidence times the others."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(column.max()) + 1, np.int32)
    forest = _Forest(len(sizes))
    for i, j in _partners(sizes, side, forest, percent):
        mark[column[first[i] : first[i + 1]]] = 1
        if len(j) > 8:
            a, b = int(j[0]), int(j[-1]) + 1
            overlap = np.add.reduceat(mark[column[first[a] : first[b]]], first[a:b] - first[a])[j - a]
        else:
            overlap = np.array([mark[column[first[k] : first[k + 1]]].sum() for k in j.tolist()])
        mark[column[first[i] : first[i + 1]]] = 0
        forest.join(i, j[overlap * (100 + percent) >= percent * (sizes[i] + sizes[j])])
    return forest


def _run_products(dealt: DataFrame, values: DataFrame, pairs_of, percent: int) -> DataFrame:
    """Edges (grp, a, b, top) of the forest of each product (grp, p, q) of rows (side, node, n); values has (node,
    value), the 64-bit words of a bitmap or set.  The tree of the row of side TOP, if there is one, is told by top and
    has its edges from that row to all others."""

    def run(batches):
        for table in _groups(batches, 3):
            if table.num_rows < 2:
                continue
            n = np.asarray(table.column(5)).astype(np.int64)
            order = np.argsort(n, kind="stable")
            ids = np.asarray(table.column(4)).astype(np.int64)[order]
            side = np.asarray(table.column(3))[order]
            words = [np.frombuffer(v.as_buffer(), np.uint64) for chunk in table.column(6).chunks for v in chunk]
            forest = pairs_of(n[order], side, [words[k] for k in order.tolist()], percent)
            i, j = np.array(forest.edges, np.int64).reshape(-1, 2).T
            top = np.zeros(len(i), bool)
            if len(at := np.flatnonzero(side == TOP)) and len(i):
                mine = forest.tree == forest.tree[at[0]]
                others = np.flatnonzero(mine & (np.arange(len(ids)) != at[0]))
                i, j = np.concatenate([i[~mine[i]], np.full(len(others), at[0])]), np.concatenate([j[~mine[i]], others])
                top = np.arange(len(i)) >= len(i) - len(others)
            if len(i):
                grp = pa.array(np.full(len(i), table.column(0)[0].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([grp, pa.array(ids[i]), pa.array(ids[j]), pa.array(top)], names=["grp", "a", "b", "top"])

    keys = ["grp", "p", "q"]
    dealt = dealt.join(values, "node").select(*keys, "side", "node", "n", "value").repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(run, "grp long, a long, b long, top boolean")


def _deal_piles(rows: DataFrame, percent: int, block: int, each: float) -> DataFrame:
    """Deals rows (grp, node, n, main) of large groups to products (grp, p, q, side, node, n) so that every pair of
    rows, not both main, whose sizes allow a link meets in one of them.

    Bands are geometric in n, so that links join equal or neighbouring bands.  Rows of a band, those of main
    apart, are dealt to blocks by hash; a product has two blocks p and q (sides 1 and 2), or one (side 0).
    """
    step = float(np.log(100 / percent)) * (1 + 1e-9)
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("long"))
    fit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(BLOCK_BYTES / (F.exp((F.col("band") + 1) * step) * each))))
    counts = rows.groupBy("grp", "band", "main").agg(F.count(F.lit(1)).alias("c")).withColumn("c", F.ceil(F.col("c") / fit).cast("long"))
    near = F.explode(F.array(*(F.struct((F.col("band") - d).alias("band"), F.lit(d).alias("d")) for d in (-1, 0, 1)))).alias("x")
    counts = counts.select("grp", near, "main", "c").select("grp", "x.*", "main", "c")
    blocks = lambda d, main: F.coalesce(F.sum(F.when((F.col("d") == d) & (F.col("main") == main), F.col("c"))), F.lit(0))
    kinds = {f"_{'m' if main else 'r'}{d + 1}": (d, main) for d in (-1, 0, 1) for main in (False, True)}
    sizes = counts.groupBy("grp", "band").agg(*(blocks(*k).alias(name) for name, k in kinds.items()))
    dealt = rows.join(bounded(sizes), ["grp", "band"])
    code = lambda d, main: (((F.col("band") + d) * 2 + int(main)) * F.lit(1 << 32)).cast("long")

    def numbered(name: str, first: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col(name) - 1), lambda j: first + j)
        return F.when(F.col(name) > 0, each).otherwise(F.array().cast("array<long>"))

    of = {name: numbered(name, code(*k)) for name, k in kinds.items()}
    others = F.when(F.col("main"), F.concat(*(of[f"_r{d}"] for d in range(3)))).otherwise(F.concat(*of.values()))
    number = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("_m1")).otherwise(F.col("_r1")))
    mine = (F.col("band") * 2 + F.col("main").cast("long")) * F.lit(1 << 32) + number
    dealt = dealt.withColumn("_mine", mine).select("grp", "node", "n", "_mine", F.explode(others).alias("_other"))
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    return dealt.select("grp", F.least("_mine", "_other").alias("p"), F.greatest("_mine", "_other").alias("q"), side.alias("side"), "node", "n")


def _thinned(tagged: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Rows (grp, node, n, main) of groups parted anew: two rows stay together only if they share one of their rarest
    n-grams.  cells are the n-grams (node, gram) of the rows.

    Of a set of n, any partner holds all but n - ceil(T n / 100), so one of the first n - ceil(T n / 100) + 1 in any
    order that is common to both.  The order is by the number of the group's rows that hold an n-gram, so pages of one
    template, which share most of theirs, begin with what is their own: a page with more of that than a partner may lack
    is in no group any more, whatever the template's share."""
    cells = tagged.join(cells, "node").select("grp", "node", "n", "main", "gram")
    held = cells.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    shared = cells.join(held, ["grp", "gram"])
    row = W.partitionBy("grp", "node")
    # n-grams of one row alone come first and are columns of nobody else
    slots = F.col("n") + F.floor(F.col("n") * percent / -100) + 1 - (F.col("n") - F.count(F.lit(1)).over(row))
    place = F.row_number().over(row.orderBy("_c", "gram"))
    columns = shared.withColumns({"_slots": slots, "_place": place}).where("_place <= _slots").select("grp", "gram", "node", "n", "main")
    columns = materialize(columns, "ngram-rare")
    lead = columns.groupBy("grp", "gram").agg(F.min("node").alias("_lead"), F.max("node").alias("_last")).where("_lead < _last").select("grp", "gram", "_lead")
    out = columns.join(lead, ["grp", "gram"]).select("grp", F.col("_lead").alias("_new"), "node", "n", "main").distinct()
    # a group's number is that of its leading row, in a space of its own for each group it was parted from
    return out.select(F.xxhash64("grp", "_new").alias("grp"), "node", "n", "main")


def _edges(rows: DataFrame, values: DataFrame, pairs_of, percent: int, block: int, each: float, cells_of=None) -> DataFrame:
    """Edges (a, b) that connect what the pairs of rows (grp, node, n, pop) that pairs_of finds do; a row's value
    has up to `each` bytes a member.  Groups with THIN blocks or more off the main part are thinned out first by
    their rows' n-grams, if cells_of(nodes) gives these."""
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"), F.sum("n").alias("total"))
    parts = F.ceil(F.greatest(F.col("c") / block, F.col("total") * each / BLOCK_BYTES)).cast("long")
    large = materialize(sizes.where(parts > 1).select("grp", parts.alias("parts"), F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(BLOCK_BYTES / (F.col("most") * each)))).alias("pivots")), "ngram-large")
    zero = F.lit(0).cast("long")
    whole = lambda d: d.select("grp", zero.alias("p"), zero.alias("q"), F.lit(0).alias("side"), "node", "n")
    if not large.limit(1).count():
        return _run_products(whole(rows), values, pairs_of, percent).select("a", "b")
    few = bounded(large)
    small, rows = rows.join(few, "grp", "left_anti"), rows.join(few, "grp")
    place = F.row_number().over(W.partitionBy("grp").orderBy(F.col("pop").desc(), "node"))
    pivots = rows.withColumn("_k", place).where((F.col("_k") <= PIVOTS) & (F.col("_k") <= F.col("pivots")))
    side = F.when(F.col("_k") == 1, F.lit(TOP)).otherwise(F.lit(1)).alias("side")
    pivots = pivots.select("grp", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("p"), zero.alias("q"), side, "node", "n")
    members = rows.select("grp", F.pmod(F.xxhash64("node"), F.col("parts")).alias("p"), zero.alias("q"), F.lit(2).alias("side"), "node", "n")
    first = materialize(_run_products(whole(small).unionByName(pivots).unionByName(members), values, pairs_of, percent), "ngram-pivots")
    # what the top pivot is connected with, itself included
    main = first.where("top").select("grp", F.col("b").alias("node")).distinct().withColumn("_in", F.lit(True))
    tagged = rows.select("grp", "node", "n").join(main, ["grp", "node"], "left").select("grp", "node", "n", F.coalesce("_in", F.lit(False)).alias("main"))
    if cells_of is not None:
        off = tagged.groupBy("grp").agg(F.count_if(~F.col("main")).alias("_off")).where(F.col("_off") >= THIN * block).select("grp")
        if off.limit(1).count():
            tagged = materialize(tagged, "ngram-tagged")
            wide = tagged.join(bounded(off), "grp", "left_semi")
            thin = _thinned(wide, cells_of(wide.select("node").distinct()), percent)
            tagged = tagged.join(bounded(off), "grp", "left_anti").unionByName(thin)
    piles = materialize(_deal_piles(tagged, percent, block, each), "ngram-piles")
    if not piles.limit(1).count():
        return first.select("a", "b")
    rest = _run_products(piles, values, pairs_of, percent)
    return first.unionByName(rest).select("a", "b")


def _blocks(cells: DataFrame) -> DataFrame:
    """(grp, node, n, pop) from (node, n, gram): the rows of each column that has several, by the leading row, and
    how many rows a row's columns have together."""
    columns = cells.groupBy("gram").agg(F.min("node").alias("grp"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("_c")).where("grp < _last").select("gram", "grp", "_c")
    return cells.join(columns, "gram").groupBy("grp", "node").agg(F.first("n").alias("n"), F.sum("_c").alias("pop"))


def ngram_components(docs: DataFrame, *, n: int = 3, percent: int = 90, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): the size of its set of n-word
    shingles and the smallest doc_id that links lead to, itself included.

    A null or blank text has no shingles and links with nothing; one of fewer than n words has its whole
    sequence as the one shingle.  Rows that repeat a text are one class, whatever their ids.  Rows with a
    null doc_id take part and get the smallest id they are connected with, null if there is none.  An empty
    table gives an empty result.  Other columns do not enter.
    """
    docs = docs.select("doc_id", "text")
    classes = frequency_classes(docs, n, part_shift(percent) is None)
    rows = materialize(incidence(docs, n, percent, classes, small), "ngram-rows")
    full = rows.where("n > 0")
    sets = full.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")).alias("at"), F.first(F.struct("n", "grams", "short", "bits")).alias("x"))
    # a class goes by a number that no other has; the table that is written fixes it
    sets = sets.select("k1", "k2", "at", F.monotonically_increasing_id().alias("node"), F.col("at.doc_id").alias("first_id"), "x.n", "x.grams", "x.short", "x.bits")
    sets = materialize(sets, "ngram-sets")

    blocks = _blocks(sets.select("node", "n", F.explode("grams").alias("gram")))
    few = sets.where("short")
    if few.limit(1).count():
        chosen = docs.withColumn("_row", row_key(F.col("text"))).join(few.select(F.col("at.doc_id").alias("_id"), F.col("at._row").alias("_at")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_at")))
        grams = materialize(single_cells(chosen, n, percent, None).select("gram").distinct(), "ngram-few")
        if grams.limit(MAX_WANTED + 1).count() <= MAX_WANTED:
            more = single_cells(docs, n, percent, np.sort(np.asarray(grams.toArrow().column("gram"), np.int64)))
        else:
            more = single_cells(docs, n, percent, None).join(grams, "gram", "left_semi")
        more = more.distinct().join(sets.select("k1", "k2", "node", "n"), ["k1", "k2"]).select("node", "n", "gram")
        blocks = blocks.unionByName(_blocks(more)).groupBy("grp", "node").agg(F.first("n").alias("n"), F.max("pop").alias("pop"))
    blocks = materialize(blocks, "ngram-blocks")
    keyed = docs.withColumn("_row", row_key(F.col("text")))

    def cells_of(nodes: DataFrame) -> DataFrame:
        at = bounded(sets.join(nodes, "node").select("node", "k1", "k2", F.col("at.doc_id").alias("_id"), F.col("at._row").alias("_at")), MAX_WANTED)
        texts = keyed.join(at, keyed["doc_id"].eqNullSafe(at["_id"]) & (F.col("_row") == F.col("_at"))).select("node", "text", "k1", "k2")
        return _cells_of(_sets_of(texts, n))

    near = _edges(blocks, sets.select("node", F.col("bits").alias("value")), possible_links, percent, block, 0.25, cells_of)
    clusters = materialize(components(near).withColumnsRenamed({"root": "grp"}), "ngram-clusters")

    popular = blocks.groupBy("node").agg(F.max("pop").alias("pop"))
    chosen = sets.join(clusters, "node").join(popular, "node").select("k1", "k2", "node", "grp", "n", "pop", F.col("at.doc_id").alias("_id"), F.col("at._row").alias("_at"))
    chosen = materialize(chosen, "ngram-chosen")
    wanted = bounded(chosen.select("node", "k1", "k2", "_id", "_at"), MAX_WANTED)
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["_id"]) & (F.col("_row") == F.col("_at"))).select("node", "text", "k1", "k2")
    full_sets = materialize(_sets_of(texts, n), "ngram-full")
    links = _edges(chosen.select("grp", "node", "n", "pop"), full_sets.withColumnRenamed("members", "value"), linked_pairs, percent, block, 8.0)
    roots = components(links)
    release(blocks, clusters, chosen, full_sets)
    labels = roots.join(sets.select("node", "first_id"), "node")
    labels = labels.join(labels.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    ids = sets.select("k1", "k2", "node", "first_id").join(labels, "node", "left").select("k1", "k2", F.coalesce("component_id", "first_id").alias("component_id"))
    out = full.select("doc_id", "n", "k1", "k2").join(ids, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _sets_of(texts: DataFrame, n: int) -> DataFrame:
    """(node, members): the sorted set of each wanted class, from a text of it; k1 and k2 are the set's hash."""

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                h, first = shingles(part.column(1), n)
                nodes, members = [], []
                want = zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), first[:-1].tolist(), first[1:].tolist())
                for node, k1, k2, a, b in want:
                    s = np.unique(h[a:b])
                    if len(s) and set_keys(s) == (k1, k2):
                        nodes.append(node)
                        members.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(members, pa.binary())], names=["node", "members"])

    return texts.select("node", "text", "k1", "k2").mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def _cells_of(sets: DataFrame) -> DataFrame:
    """(node, gram) for every member of the sets (node, members)."""

    def run(batches):
        for batch in batches:
            for node, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = np.frombuffer(members.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), node)), pa.array(grams)], names=["node", "gram"])

    return sets.select("node", "members").mapInArrow(run, "node long, gram long")


def drop_near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component left: that of the smallest doc_id (one of its rows, if several
    have it).  Rows without shingles and rows with a null doc_id all stay.  Columns stay as they are."""
    found = ngram_components(docs, n=n, percent=percent).where("n_shingles > 0")
    found = materialize(found, "ngram-found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").select("doc_id")
    # an id whose rows have different texts, one of them first of its component: that row stays
    mixed = again.join(gone, "doc_id", "left_semi")
    plain = docs.join(gone.unionByName(again).distinct(), "doc_id", "left_anti")
    rest = docs.join(again.join(mixed, "doc_id", "left_anti"), "doc_id", "left_semi")
    # of rows that share an id that with the smallest text, whatever order they come in
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.md5(F.coalesce("text", F.lit(""))), F.md5(F.to_json(row)))
    one = rest.groupBy("doc_id").agg(F.min_by(row, order).alias("_row"))
    return plain.unionByName(one.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's number of three-word shingles and its component at a similarity of 0.9; see
    ngram_components() for nulls, short texts and repeats."""
    return ngram_components(read(spark, sf_dir, "documents"), n=3, percent=90)
