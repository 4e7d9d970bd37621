"""Personal data: base patterns and information-theoretic sanitisation.

Base spans are emails, addresses, cards and phones by pattern.  Words beside such an entity may give it
away even when it is masked: a term t discloses entity e by PMI(e; t) / IC(e), estimated from the corpus
as log2(d(e,t) N / (d(e) d(t))) / log2(N / d(e)), where d counts documents, and d(e,t) those that hold both.
d(e) counts all documents that hold e, whatever stands beside it.  Terms that stand within `window` terms of e somewhere are tried.  A term that reaches `generalise_at` is
generalised (its kind stands in its place), one that reaches `remove_at` is removed, wherever it stands in any
document.  A pair needs `support` documents with both; an entity of fewer documents than that has its estimate
smoothed by PRIOR documents that hold t and say nothing about e.

Entities, their neighbours and the terms of documents with entities are found in one pass and written as a
table of places and hashes.  Entities and terms (numbers are terms too) are hashed with a key that only the running
job has, so nobody can find them again by hashing guesses, and the tables are emptied once the terms are known.  Terms that may disclose need a corpus count, which is a second pass that sums per Arrow slice
before anything is shuffled.  A third pass finds the disclosing terms in whole texts and sanitises these.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import bounded, materialize, read, release, row_key

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 6
SUPPORT = 2
#: Documents that hold a term and say nothing about the entity, added where an entity has less than SUPPORT.
PRIOR = 1.0
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Candidate terms that travel with the task for counting (8 bytes each); beyond that all terms are counted.
MAX_CANDIDATES = 1_000_000
STEP_BYTES, STEP_ROWS = 4_000_000, 4096

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Bytes between terms: ASCII other than letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from each @: the local part is the run before it that no
    earlier email has taken.  Linear in the text, whatever it holds."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str, has_digit: bool = True) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start, in code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not has_digit:
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _ascii_lower(s: str) -> str:
    return s.encode().translate(tc.LOWER.tobytes()).decode()


def touching(spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of the stretches start to end overlaps one of the spans (kind, start, end)."""
    if not spans:
        return np.zeros(len(start), bool)
    at = np.array(sorted((a, b) for _, a, b in spans))
    reach = np.maximum.accumulate(at[:, 1])  # the furthest end of the spans up to each
    before = np.searchsorted(at[:, 0], end, "left")
    return (before > 0) & (reach[np.maximum(before, 1) - 1] > start)


def neighbours(spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(span number, term number) of the terms (start to end, in order) of 3 or more characters up to `window`
    terms before and after each span, none of which touches a span."""
    a, b = (np.array([s[k] for s in spans], np.int64) for k in (1, 2))
    near = np.concatenate([np.searchsorted(end, a, "right")[:, None] - 1 - np.arange(window), np.searchsorted(start, b, "left")[:, None] + np.arange(window)], axis=1)
    span, term = np.repeat(np.arange(len(spans)), 2 * window), near.ravel()
    inside = (term >= 0) & (term < len(start))
    span, term = span[inside], term[inside]
    fit = (end - start >= 3) & ~touching(spans, start, end)
    return span[fit[term]], term[fit[term]]


def _round(v: list[np.ndarray]) -> list[np.ndarray]:
    """A round of SipHash on columns."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    a, b, c, d = v
    a, c = a + b, c + d
    b, d = turn(b, 13) ^ a, turn(d, 16) ^ c
    a, c = turn(a, 32) + d, c + b
    d, b = turn(d, 21) ^ a, turn(b, 17) ^ c
    return [a, b, turn(c, 32), d]


def keyed(h: np.ndarray, key: bytes) -> np.ndarray:
    """SipHash-2-4 of 64-bit numbers (as 8 little-endian bytes) under a key of 16 bytes."""
    h = h.view(np.uint64)
    k0, k1 = np.frombuffer(key, "<u8")
    start = [int.from_bytes(x, "big") for x in (b"somepseu", b"dorandom", b"lygenera", b"tedbytes")]
    v = [np.full(len(h), np.uint64(x) ^ k, np.uint64) for x, k in zip(start, (k0, k1, k0, k1))]
    for block in (h, np.full(len(h), np.uint64(8 << 56))):
        v[3] = v[3] ^ block
        v = _round(_round(v))
        v[0] = v[0] ^ block
    v[2] = v[2] ^ np.uint64(0xFF)
    for _ in range(4):
        v = _round(v)
    return (v[0] ^ v[1] ^ v[2] ^ v[3]).view(np.int64)


_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _span_lists(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 3)
    return _lists([len(s) for s in spans], pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_FOUND)))


def term_spans(texts: pa.Array, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, keyed hash, start, end) of every term of the texts, in order; start and end in code points of the row."""
    raw, off, _ = tc.column_bytes(texts)
    low = tc.LOWER[raw]
    begin, end, first = tc.spans(low, off, _BETWEEN)
    h = keyed(tc.span_hashes(low, begin, end), key)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    at = points[off[:-1]][row]
    return row, h, points[begin] - at, points[end] - at


def base_of(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Base spans of each text; texts without a digit or an @ are not made Python strings."""
    raw, off, _ = tc.column_bytes(texts)
    digits = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 48) & (raw <= 57), out=digits[1:])
    some = digits[off[1:]] > digits[off[:-1]]
    at = np.flatnonzero(raw == 64)
    some_at = np.searchsorted(at, off[1:]) > np.searchsorted(at, off[:-1])
    base = [[]] * len(texts)
    for i in np.flatnonzero(some | some_at).tolist():
        base[i] = base_spans(texts[i].as_py(), bool(some[i]))
    return base


def find_entities(docs: DataFrame, window: int, key: bytes) -> DataFrame:
    """(doc_id, _row, entities, near, held) of each row with a base span: its distinct entities, the pairs of an
    entity and (the keyed hash of) a term beside it, and the keyed hashes of all its terms."""

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 2, STEP_BYTES, STEP_ROWS):
                texts, base = part.column(2), base_of(part.column(2))
                mine = [i for i, s in enumerate(base) if s]
                row, h, start, end = term_spans(texts.take(pa.array(mine, pa.int64())), key)
                cut = np.searchsorted(row, np.arange(len(mine) + 1))
                entities, near_entity, near_hash, held = [], [], [], []
                for k, i in enumerate(mine):
                    text, (a, b) = texts[i].as_py(), cut[k : k + 2]
                    names = [hashlib.blake2b(f"{KINDS[kind]}:{_ascii_lower(text[x:y])}".encode(), digest_size=16, key=key).digest() for kind, x, y in base[i]]
                    known = {n: j for j, n in enumerate(dict.fromkeys(names))}
                    span, term = neighbours(base[i], start[a:b], end[a:b], window)
                    number = np.array([known[n] for n in names])
                    pairs = np.unique(np.stack([number[span], h[a:b][term]]), axis=1)
                    every = list(known)
                    entities.append(every)
                    near_entity.append([every[j] for j in pairs[0].tolist()])
                    near_hash.append(pairs[1])
                    held.append(np.unique(h[a:b]))
                longs = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
                names = pa.array([n for e in near_entity for n in e], pa.binary())
                columns = [
                    part.column(0).take(pa.array(mine, pa.int64())),
                    part.column(1).take(pa.array(mine, pa.int64())),
                    pa.array(entities, pa.list_(pa.binary())),
                    _lists([len(e) for e in near_entity], pa.StructArray.from_arrays([names, longs(near_hash)], names=["entity", "hash"])),
                    _lists([len(x) for x in held], longs(held)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "entities", "near", "held"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kept = docs.select("doc_id", row_key(F.col("text")).alias("_row"), "text")
    return kept.mapInArrow(run, f"doc_id {id_type}, _row long, entities array<binary>, near array<struct<entity:binary,hash:long>>, held array<long>")


def count_terms(docs: DataFrame, candidates: np.ndarray | None, key: bytes) -> DataFrame:
    """(hash, d): in how many rows of docs each term stands; of the sorted candidates only, if given."""

    def rows_with(part: pa.RecordBatch) -> np.ndarray:
        """The term of each (row, term) of the slice, once."""
        raw, off, _ = tc.column_bytes(part.column(0))
        begin, end, first = tc.spans(tc.LOWER[raw], off, _BETWEEN)
        h = keyed(tc.span_hashes(tc.LOWER[raw], begin, end), key)
        row = np.repeat(np.arange(part.num_rows), np.diff(first))
        if candidates is not None:
            at = np.minimum(np.searchsorted(candidates, h), len(candidates) - 1)
            hit = candidates[at] == h
            h, row = at[hit], row[hit]
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return h[new]

    def out(term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["hash", "n"])

    def run(batches):
        total = None if candidates is None else np.zeros(len(candidates), np.int64)
        for batch in batches:
            for part in tc.in_steps(batch, 0, STEP_BYTES, STEP_ROWS):
                if total is None:
                    yield out(*np.unique(rows_with(part), return_counts=True))
                else:
                    total += np.bincount(rows_with(part), minlength=len(total))
        if total is not None:
            yield out(candidates[total > 0], total[total > 0])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("d"))


def disclosing_terms(docs: DataFrame, found: DataFrame, key: bytes, *, support: int, generalise_at: float) -> DataFrame:
    """(hash, disclosure) of terms whose disclosure of some entity reaches generalise_at, by the most that it is.  Its
    own tables are emptied."""
    total = docs.count()
    # a row is a document: rows that repeat an id and text count once each
    copies = found.groupBy("doc_id", "_row").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("entities", "near", "held")))
    copies = materialize(copies, "pii-copies")
    of = copies.select("doc_id", "_row", "copies", F.explode("entities").alias("entity"))
    entities = of.groupBy("entity").agg(F.sum("copies").alias("d_entity"), F.count(F.lit(1)).alias("n_rows"))
    # a term's documents are at least those of them that hold an entity, and those with both at most the entity's,
    # which bounds the disclosure: pairs that can't reach the threshold need no counts
    held = copies.select("copies", F.explode("held").alias("hash")).groupBy("hash").agg(F.sum("copies").alias("d_held"))
    both = copies.select(F.explode("near").alias("x")).select("x.entity", "x.hash").distinct().join(entities, "entity").join(held, "hash")

    def disclosure(d_both: Column, d: Column) -> Column:
        prior = F.when(F.col("d_entity") < support, F.lit(PRIOR)).otherwise(F.lit(0.0))
        pmi = F.log2((d_both + prior * F.col("d_entity") / float(total)) * F.lit(float(total)) / (F.col("d_entity") * (d + prior)))
        return F.when(F.col("d_entity") < total, pmi / F.log2(F.lit(float(total)) / F.col("d_entity"))).otherwise(F.lit(0.0))

    most = F.least(F.col("d_entity"), F.col("d_held"))
    bound = both = materialize(both.where(disclosure(most, F.col("d_held")) >= generalise_at - 1e-6), "pii-near-bound")
    # an entity of one document has its neighbours there; of others, the documents with both are counted
    one, several = both.where("n_rows = 1").withColumn("d_both", F.col("d_entity")), both.where("n_rows > 1")
    has = of.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("entity").alias("_e"))
    holds = copies.select("doc_id", "_row", "copies", F.explode("held").alias("hash")).join(bounded(several.select("entity", "hash")), "hash")
    holds = holds.join(has, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")) & (F.col("entity") == F.col("_e")), "left_semi")
    met = holds.groupBy("entity", "hash").agg(F.sum("copies").alias("d_both"))
    both = one.unionByName(several.join(met, ["entity", "hash"])).where((F.col("d_both") >= support) | (F.col("d_entity") < support))
    both = both.where(disclosure(F.col("d_both"), F.col("d_held")) >= generalise_at - 1e-6).drop("d_held", "n_rows")
    pairs = both = materialize(both, "pii-pairs")
    release(copies, bound)
    terms = both.select("hash").distinct()
    if terms.limit(MAX_CANDIDATES + 1).count() <= MAX_CANDIDATES:
        chosen = np.sort(np.asarray(terms.toArrow().column("hash"), np.int64))
        counts = count_terms(docs, chosen if len(chosen) else np.zeros(1, np.int64), key)
    else:
        counts = count_terms(docs, None, key)
    both = both.join(counts, "hash")
    both = both.withColumn("disclosure", F.round(disclosure(F.col("d_both"), F.col("d")), 9))
    strong = materialize(both.where(F.col("disclosure") >= generalise_at).groupBy("hash").agg(F.max("disclosure").alias("disclosure")), "pii-terms")
    release(pairs)
    return strong


def sanitised(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, float]], remove_at: float) -> str:
    """The text with base spans as their kind in brackets, and terms as their general kind ([number] or [word]) or,
    from remove_at on, taken out; a span that begins inside an earlier one is part of it."""
    put = [(a, b, f"[{KINDS[k]}]") for k, a, b in base]
    put += [(a, b, "" if d >= remove_at else "[number]" if text[a:b].isdigit() and text[a:b].isascii() else "[word]") for a, b, d in terms]
    out, at = [], 0
    for a, b, new in sorted(put):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join(out) + text[at:]


_OUT = "base array<struct<kind:int,start:int,end:int>>, terms array<struct<start:int,end:int,disclosure:double>>, sanitised string"
_TERMS = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("disclosure", pa.float64())]


def _finish(texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray, disclosure: np.ndarray, remove_at: float) -> list[pa.Array]:
    """base, terms and sanitised of texts, from the places of disclosing terms in order of row and start."""
    base, new = base_of(texts), texts.cast(pa.string())
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    free, changed = np.ones(len(row), bool), {}
    for i in [i for i, s in enumerate(base) if s or cut[i + 1] > cut[i]]:
        mine = slice(cut[i], cut[i + 1])
        free[mine] = ~touching(base[i], start[mine], end[mine])
        at = np.flatnonzero(free[mine]) + cut[i]
        changed[i] = sanitised(texts[i].as_py(), base[i], list(zip(start[at].tolist(), end[at].tolist(), disclosure[at].tolist())), remove_at)
    if changed:
        put = np.zeros(len(texts), bool)
        put[list(changed)] = True
        new = pc.replace_with_mask(new, pa.array(put), pa.array([changed[i] for i in sorted(changed)], pa.string()))
    sizes = np.bincount(row[free], minlength=len(texts))
    terms = pa.StructArray.from_arrays([pa.array(start[free].astype(np.int32)), pa.array(end[free].astype(np.int32)), pa.array(disclosure[free].astype(np.float64))], fields=_TERMS)
    return [_span_lists(base), _lists(sizes.tolist(), terms), new]


def apply_terms(docs: DataFrame, strong: DataFrame, remove_at: float, key: bytes) -> DataFrame:
    """(doc_id, _row, base, terms, sanitised) of each row, from the disclosing terms (hash, disclosure).  Beyond
    MAX_CANDIDATES of these, places of all terms are joined with them, and what is found with the texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kept = docs.select("doc_id", row_key(F.col("text")).alias("_row"), "text")
    if strong.limit(MAX_CANDIDATES + 1).count() <= MAX_CANDIDATES:
        table = strong.toArrow().sort_by("hash")
        chosen, weight = np.asarray(table.column("hash"), np.int64), np.asarray(table.column("disclosure"), np.float64)
        release(strong)

        def run(batches):
            for batch in batches:
                for part in tc.in_steps(batch, 2, STEP_BYTES, STEP_ROWS):
                    row, h, start, end = term_spans(part.column(2), key)
                    at = np.minimum(np.searchsorted(chosen, h), max(len(chosen) - 1, 0))
                    hit = np.flatnonzero(chosen[at] == h) if len(chosen) else np.zeros(0, np.int64)
                    found = _finish(part.column(2), row[hit], start[hit], end[hit], weight[at[hit]] if len(chosen) else np.zeros(0), remove_at)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=["doc_id", "_row", "base", "terms", "sanitised"])

        return kept.mapInArrow(run, f"doc_id {id_type}, _row long, {_OUT}")

    def places(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 2, STEP_BYTES, STEP_ROWS):
                row, h, start, end = term_spans(part.column(2), key)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(h), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "_row", "hash", "start", "end"])

    def finish(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 2, STEP_BYTES, STEP_ROWS):
                hits = part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.asarray(pc.fill_null(pc.list_value_length(hits), 0)))
                flat = hits.flatten()
                found = _finish(part.column(2), row, *(np.asarray(flat.field(k)) for k in range(3)), remove_at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=["doc_id", "_row", "base", "terms", "sanitised"])

    every = kept.mapInArrow(places, f"doc_id {id_type}, _row long, hash long, start int, end int")
    hit = every.join(strong, "hash").select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), "start", "end", "disclosure").distinct()
    hit = hit.groupBy("_d", "_r").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("_hits"))
    joined = kept.join(hit, kept["doc_id"].eqNullSafe(hit["_d"]) & (kept["_row"] == hit["_r"]), "left").select("doc_id", "_row", "text", "_hits")
    return joined.mapInArrow(finish, f"doc_id {id_type}, _row long, {_OUT}")


def sanitise(docs: DataFrame, *, window: int = WINDOW, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(doc_id, _row, base, terms, sanitised) for each row of docs: base spans (kind, start, end), spans of
    disclosing terms with their disclosure (a term that touches a base span is part of it), and the text
    with base spans masked, terms generalised and, from remove_at on, removed.

    A null text counts as empty, has no spans and stays null.  A row is a document in all counts, repeated
    rows too; they get equal results.  Columns other than doc_id and text do not enter.
    """
    docs = docs.select("doc_id", "text")
    key = os.urandom(16)
    found = materialize(find_entities(docs, window, key), "pii-found")
    strong = disclosing_terms(docs, found, key, support=support, generalise_at=generalise_at)
    release(found)
    return apply_terms(docs, strong, remove_at, key)


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the text that sanitise() made of each; other columns stay, whatever their names, and so do
    nulls and repeated rows."""
    one = found.dropDuplicates(["doc_id", "_row"]).select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("sanitised").alias("_new"))
    d = docs.select(F.struct(*docs.columns).alias("_own"), row_key(F.col("text")).alias("_key"))
    d = d.join(one, F.col("_own.doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_r")), "left")
    return d.select(*(F.col("_new").alias(c) if c == "text" else F.col("_own")[c].alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's base and method spans, how many terms are generalised and removed, and the sanitised
    text's hash; see sanitise() for nulls, empties and repeats."""
    found = sanitise(read(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    terms = F.transform("terms", lambda s: F.struct(F.lit(4).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    gone = F.size(F.filter("terms", lambda s: s["disclosure"] >= REMOVE_AT)).cast("long")
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", terms)).alias("spans"),
        (F.size("terms") - gone).alias("n_generalised"),
        gone.alias("n_removed"),
        F.sha2(F.coalesce("sanitised", F.lit("")), 256).alias("sanitised_sha256"),
    )
