"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than the six ASCII whitespace bytes
(0x20 and 0x09-0x0D); UTF-8 never uses these inside a longer character, so the
byte view and the code-point view find the same words.  Everything works on a
whole Arrow batch at once: the string buffer is viewed as one byte array and
each word gets a 64-bit hash from prefix sums of random byte codes times powers
of an odd base, so the cost per byte is a handful of numpy operations and no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.RandomState(20240607)
_BASE = np.uint64(int(_rng.randint(1, 1 << 62)) * 2 + 1)
_CODE = _rng.randint(1, 1 << 62, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER: dict[str, np.ndarray] = {}

#: Bytes hashed at a time; the power tables have this length.
PIECE = 1 << 21


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWER.get("up")
    if have is None or len(have) < size + 1:
        size = max(size, PIECE)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = _BASE, inverse
        _POWER["up"], _POWER["down"] = np.cumprod(up), np.cumprod(down)
    return _POWER["up"], _POWER["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, the row offsets into them, and which rows are null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    n = len(column)
    null = np.asarray(column.is_null()) if n else np.zeros(0, bool)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    off = off - off[0]
    if null.any():  # a null row's slot may hold bytes
        keep = np.where(null, 0, np.diff(off))
        if keep.sum() != len(raw):
            raw = raw[np.repeat(~null, np.diff(off))]
        off = np.concatenate([[0], np.cumsum(keep)])
    return raw, off, null


def spans(raw: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and for each row the index of its first word
    (with the total at the end).  Bytes marked in `between` part words, and so does a row's end."""
    solid = ~between[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    cut = off[1:-1]
    cut = cut[cut < len(raw)]
    start[cut] = solid[cut]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[cut > 0]
    stop[cut - 1] = solid[cut - 1]
    begin = np.flatnonzero(start)
    end = np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(begin, off)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (in ascending order, not overlapping, none longer than memory)."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        lo = begin[i]
        j = int(np.searchsorted(end, lo + PIECE, "right"))
        j = max(j, i + 1)
        part = raw[lo : end[j - 1]]
        up, down = _powers(len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_CODE[part] * up[: len(part)], out=total[1:])
        b, e = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[b]) * down[b] + (e - b).astype(np.uint64)
        i = j
    return mix(out)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word index of each row)."""
    begin, end, first = spans(raw, off)
    return span_hashes(raw, begin, end), first


_ODD = _rng.randint(1, 1 << 62, size=16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for each i with n words left, whatever rows they are in."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * _ODD[0]
    for k in range(1, n):
        total += words[k : k + m] * _ODD[k % 16] if k < 16 else mix(words[k : k + m] + np.uint64(k))
    return mix(total)


def in_steps(batch: pa.RecordBatch, column: int, most: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and, unless a single row is larger, `most` bytes of the
    column: whatever the batch size, memory follows the largest text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    a = total = 0
    for i, size in enumerate(sizes):
        if i > a and (total + size > most or i - a >= rows):
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += size
    if len(sizes) > a:
        yield batch.slice(a)
