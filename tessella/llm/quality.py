"""Quality rules: hashed word and character n-gram logistic regression beside fixed counts.

The counts and the features come from whole Arrow slices with numpy.  The model is fitted on a bounded
sample of labelled rows, its logits are calibrated on the part of the sample that the fit doesn't see,
and every text is scored in slices against fixed thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Fixed values of the rules.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.5
SYMBOLS = b"#*$%&|<>"
#: Hash buckets for word n-grams (1 and 2) and for character n-grams (3 bytes), and the sample's bound.
WORD_DIM, CHAR_DIM = 2048, 2048
MAX_TRAIN = 4000
ROUNDS, PENALTY = 250, 1e-4
STEP_BYTES, STEP_ROWS = 1_500_000, 512

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_STARTS_CHAR = np.ones(256, bool)
_STARTS_CHAR[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeat_words(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each row, how many words lie in windows of `window` words that stand in it twice or more."""
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    h = tc.window_hashes(words, window)
    if not len(h):
        return out
    row = np.repeat(np.arange(n), np.diff(first))
    inside = row[: len(h)] == row[window - 1 :]
    rows, h = row[: len(h)][inside], h[inside]
    key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))  # a first look, by 44 bits
    same = np.unique(key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64)
    begin = np.searchsorted(rows, np.arange(n + 1))
    for r in same.tolist():
        a, b = begin[r], begin[r + 1]
        _, inverse, count = np.unique(h[a:b], return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[inverse] > 1)
        edge = np.zeros(b - a + window + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        out[r] = int((np.cumsum(edge) > 0).sum())
    return out


def repeated_lines(raw: np.ndarray, off: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each row, how many of its lines with a word equal an earlier line of it."""
    n = len(off) - 1
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([off[:-1], breaks + 1]))  # a row's first line begins where the row does
    row = np.searchsorted(off[1:], start, "right")
    end = np.full(len(start), len(raw))
    end[:-1] = start[1:]
    # lines that begin at a row's end belong to the next row unless a break stands before them
    at_break = np.zeros(len(raw) + 1, bool)
    at_break[breaks] = True
    worded = np.searchsorted(begin, end) - np.searchsorted(begin, start)
    keep = worded > 0
    start, end, row = start[keep], end[keep], row[keep]
    end = np.where(at_break[end - 1], end - 1, end)  # without the break itself
    h = tc.span_hashes(raw, start, end)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=n)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text."""
    raw, off, _ = tc.column_bytes(column)
    begin, end, first = tc.spans(raw, off)
    n_words = np.diff(first)
    repeated = repeat_words(tc.span_hashes(raw, begin, end), first)
    return {
        "n_words": n_words,
        "word_chars": _per_row(_STARTS_CHAR[raw] & ~tc.SPACE[raw], off),
        "n_symbols": _per_row(_IS_SYMBOL[raw], off),
        "n_dup_lines": repeated_lines(raw, off, begin),
        "n_repeat_words": repeated,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words),
    }


def _unit_logs(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: unit log counts of hashed word n-grams and of hashed character n-grams, then a
    few shares (distinct words, capitals, symbols, the weight of the heaviest bucket) and the log size."""
    raw, off, _ = tc.column_bytes(column)
    n = len(off) - 1
    begin, end, first = tc.spans(raw, off)
    words = tc.span_hashes(raw, begin, end)
    row = np.repeat(np.arange(n), np.diff(first))
    two = tc.window_hashes(words, 2)
    together = row[:-1] == row[1:]
    grams = np.concatenate([row * WORD_DIM + (words % np.uint64(WORD_DIM)).astype(np.int64), (row[:-1] * WORD_DIM + (two % np.uint64(WORD_DIM)).astype(np.int64))[together] if len(two) else np.zeros(0, np.int64)])
    by_word = np.bincount(grams, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    wide = raw.astype(np.uint32)
    three = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) if len(raw) > 2 else np.zeros(0, np.uint32)
    bucket = ((three * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(off))
    inside = owner[: len(three)] == owner[2:] if len(three) else np.zeros(0, bool)
    by_char = np.bincount((owner[: len(three)] * CHAR_DIM + bucket)[inside], minlength=n * CHAR_DIM).reshape(n, CHAR_DIM)
    size = np.maximum(np.diff(first), 1).astype(np.float32)
    chars = np.maximum(np.diff(off), 1).astype(np.float32)
    spread = (by_word > 0).sum(axis=1) / np.minimum(2 * size, WORD_DIM)
    extra = np.stack([spread, by_word.max(axis=1) / size, _per_row(_UPPER[raw], off) / chars, _per_row(_IS_SYMBOL[raw], off) / chars, np.log1p(np.diff(first)) / 8, np.ones(n)], axis=1)
    return np.hstack([_unit_logs(by_word), _unit_logs(by_char), extra.astype(np.float32)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Weights of a regularised logistic regression by accelerated gradient steps; the classes weigh alike."""
    share = max(y.mean(), 1e-3), max(1 - y.mean(), 1e-3)
    each = np.where(y > 0, 0.5 / share[0], 0.5 / share[1]).astype(np.float32) / len(y)
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w.copy(), 1.0
    step = 4 / float((each * (x * x).sum(axis=1)).sum() + penalty)
    for _ in range(rounds):
        slope = x.T @ (each * (_sigmoid(x @ ahead) - y).astype(np.float32)) + penalty * ahead
        new = ahead - step * slope
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nt * (new - w)
        w, t = new, nt
    return w


def fit_calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve through held-out logits (Platt), by Newton steps."""
    if len(z) < 10 or y.min() == y.max():
        return 1.0, 0.0
    # Platt's targets keep the curve finite where the logits separate the classes
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    goal = np.where(y > 0, up, down)
    loss = lambda c: float((np.logaddexp(0, c[0] * z + c[1]) - goal * (c[0] * z + c[1])).sum() + 5e-4 * c[0] ** 2)
    c = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(c[0] * z + c[1])
        v = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * z).sum() + 1e-3 * c[0], (p - goal).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        d, size = np.linalg.solve(h, g), 1.0
        while size > 1e-10 and loss(c - size * d) > loss(c) - 1e-4 * size * float(g @ d):
            size /= 2  # a whole step may lead away where the curve is flat
        c = c - size * d
        if np.abs(size * d).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, label, _t) of the documents of at most `most` labelled ids (doc_id, label), those with the
    smallest hash.  An id with several labels has the least of them; docs may repeat an id, and _t, a text's hash,
    tells which of its rows comes first.  The sample is bounded, so it is broadcast."""
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "label"))
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).drop("_id").withColumn("_t", F.xxhash64("text"))


def train_quality(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float, float] | None:
    """(weights, calibration slope, intercept) from labels (doc_id, label 0/1) of docs; None if the sample
    lacks one of the two labels, and then the method has no verdict and keeps what the base keeps."""

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                x = features(part.column(1)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "label", "_t", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels.select("doc_id", F.col("label").cast("int").alias("label")), max_train)
    found = sample.mapInArrow(run, f"doc_id {id_type}, label int, _t long, x binary").groupBy("doc_id").agg(F.min(F.struct("_t", "label", "x")).alias("_x"))
    found = found.select("doc_id", "_x.label", "_x.x").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(found.num_rows, -1).astype(np.float32)
    y = np.asarray(found.column("label")).astype(np.float32)
    if y.min() == y.max():
        return None
    held = np.arange(len(y)) % 5 == 0
    w = fit_logistic(x[~held], y[~held])
    return w, *fit_calibration(x[held].astype(np.float64) @ w, y[held])


def quality_rules(docs: DataFrame, model: tuple[np.ndarray, float, float] | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (calibrated
    probability of good quality) and kept, for each row of docs.

    A null or empty text has no words, so it fails the base.  Repeated rows give equal rows; columns other
    than doc_id and text do not enter.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                base = base_counts(part.column(1))
                if model is None:
                    score = np.ones(part.num_rows)
                else:
                    w, a, b = model
                    score = _sigmoid(a * (features(part.column(1)) @ w).astype(np.float64) + b)
                kept = ~base["base_failed"] & (score >= KEEP_AT)
                columns = [part.column(0), *(pa.array(base[k].astype(np.int64)) for k in names), pa.array(base["base_failed"]), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "score", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, score double, kept boolean")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's base counts, calibrated score and verdict; see quality_rules() for nulls, empties and repeats."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    model = train_quality(docs, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    return quality_rules(docs, model)
