"""Quality classifier: gated attention over passages (multiple-instance learning).

Only documents have labels; what makes one bad may be a few of its passages.  A text is cut into passages
of PASSAGE words, the last one shorter; each passage is encoded as a vector of shares; a small network
learns from document labels how much each passage counts (a gated attention weight) and scores the
weighted mean of the passages' representations.  It is trained on a bounded sample of labelled rows and
applied to Arrow slices, a whole text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import materialize
from .quality import labelled_sample

PASSAGE = 64
HIDDEN, GATE = 32, 16
#: Labelled documents that are learned from, at most, and passages that these have together (DIM half-precision
#: numbers each); documents that would exceed it are passed over in the order of their ids' hashes.
MAX_TRAIN, MAX_TRAIN_PASSAGES = 4000, 400_000
EPOCHS, BATCH_DOCS, RATE, DECAY = 14, 128, 4e-3, 1e-4
SEED = 11
PREDICT_AT = 0.3
STEP_BYTES, STEP_ROWS = 1_000_000, 1024

#: Classes of bytes, each counted by its share: letters of either case, digits, non-ASCII, kinds of marks.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"|", b"#*", b"$%&", b"<>", b"'\"", b"-_", b"()[]{}", b":;", b"/\\@=+"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
PAIRS, SHADES = 64, 128
DIM = N_CLASSES + PAIRS + 6


def encode_passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, first): a vector for each passage, and each row's first passage (with the total at the
    end).  A text without words has one passage, the zero vector."""
    raw, off, _ = tc.column_bytes(column)
    n = len(off) - 1
    begin, end, first = tc.spans(raw, off)
    count = np.diff(first)
    passages = np.maximum(-(-count // PASSAGE), 1)
    start = np.concatenate([[0], np.cumsum(passages)])
    row = np.repeat(np.arange(n), count)
    of_word = start[row] + (np.arange(len(begin)) - first[row]) // PASSAGE
    total = int(start[-1])
    if not len(begin):
        return np.zeros((total, DIM), np.float32), start
    length = end - begin
    of_byte = np.repeat(of_word, length)
    solid = raw[~tc.SPACE[raw]]
    n_bytes = np.maximum(np.bincount(of_byte, minlength=total), 1)[:, None]
    n_words = np.maximum(np.bincount(of_word, minlength=total), 1)
    classes = np.bincount(of_byte * N_CLASSES + _CLASS[solid], minlength=total * N_CLASSES).reshape(total, -1) / n_bytes
    two = ((tc.LOWER[solid[:-1]].astype(np.uint32) << np.uint32(8) | tc.LOWER[solid[1:]]) * np.uint32(2654435761)) >> np.uint32(26)
    inside = np.ones(len(solid), bool)
    inside[np.cumsum(length)[first[1:][count > 0] - 1] - 1] = False  # a row's last byte pairs with none of the next row
    pairs = np.bincount((of_byte[:-1] * PAIRS + two.astype(np.int64))[inside[:-1]], minlength=total * PAIRS).reshape(total, -1) / n_bytes
    h = tc.span_hashes(raw, begin, end)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shade = np.zeros((total, SHADES), bool)
    shade[of_word, (h % np.uint64(SHADES)).astype(np.int64)] = True
    mean = np.bincount(of_word, length, minlength=total) / n_words
    square = np.bincount(of_word, length.astype(np.float64) ** 2, minlength=total) / n_words
    expected = SHADES * (1 - (1 - 1 / SHADES) ** n_words)
    more = [
        np.bincount(of_word, again, minlength=total) / n_words,
        shade.sum(axis=1) / expected,
        np.minimum(mean, 40) / 10,
        np.minimum(np.sqrt(np.maximum(square - mean * mean, 0)), 40) / 10,
        n_words / PASSAGE,
        np.bincount(of_word, (_CLASS[raw[end - 1]] > 1), minlength=total) / n_words,
    ]
    x = np.hstack([4 * classes, 8 * pairs, np.stack(more, axis=1)]).astype(np.float32)
    x[start[:-1][count == 0]] = 0
    return x, start


class AttentionModel:
    """Passage representation h = tanh(x P); attention softmax(w . (tanh(h V) * sigmoid(h U))) over a
    document's passages; logit = c . (weighted mean of h) + b."""

    def __init__(self, weights: dict[str, np.ndarray], center: np.ndarray, scale: np.ndarray):
        self.weights, self.center, self.scale = weights, center, scale

    @staticmethod
    def fresh(center: np.ndarray, scale: np.ndarray) -> AttentionModel:
        r = np.random.RandomState(SEED)
        new = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        weights = {"P": new(len(center) + 1, HIDDEN), "V": new(HIDDEN, GATE), "U": new(HIDDEN, GATE), "w": new(GATE, 1), "c": new(HIDDEN, 1), "b": np.zeros((1, 1), np.float32)}
        return AttentionModel(weights, center, scale)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        k, start = self.weights, first[:-1]
        x = np.clip((x - self.center) / self.scale, -6, 6)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        h = np.tanh(x @ k["P"])
        v, u = np.tanh(h @ k["V"]), 1 / (1 + np.exp(-(h @ k["U"])))
        e = ((v * u) @ k["w"])[:, 0]
        bag = np.repeat(np.arange(len(start)), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a /= np.add.reduceat(a, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ k["c"] + k["b"], -30, 30)[:, 0].astype(np.float64)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "bag": bag, "z": z, "p": p}

    def slopes(self, s: dict[str, np.ndarray], y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss."""
        k = self.weights
        dl = ((s["p"] - y) * each).astype(np.float32)[:, None]
        dz = dl @ k["c"].T
        at = dz[s["bag"]]
        da = (at * s["h"]).sum(axis=1)
        mean = np.bincount(s["bag"], s["a"] * da, minlength=len(y))
        de = (s["a"] * (da - mean[s["bag"]])).astype(np.float32)[:, None]
        gate = de @ k["w"].T
        dv, du = gate * s["u"] * (1 - s["v"] ** 2), gate * s["v"] * s["u"] * (1 - s["u"])
        dh = s["a"][:, None] * at + dv @ k["V"].T + du @ k["U"].T
        dp = dh * (1 - s["h"] ** 2)
        return {"P": s["x"].T @ dp, "V": s["h"].T @ dv, "U": s["h"].T @ du, "w": (s["v"] * s["u"]).T @ de, "c": s["z"].T @ dl, "b": dl.sum(keepdims=True).reshape(1, 1)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        """Adam over documents in seeded order; the classes weigh alike up to the square root of their odds."""
        share = max(float(y.mean()), 1e-3)
        odds = np.sqrt((1 - share) / share) if share < 1 else 1.0
        each = np.where(y > 0, odds, 1.0)
        r = np.random.RandomState(SEED + 1)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH_DOCS):
                some = order[at : at + BATCH_DOCS]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
                state = self.forward(np.vstack([bags[i] for i in some]).astype(np.float32), first)
                t += 1
                for k, g in self.slopes(state, y[some], each[some] / len(some)).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    step = m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * (step + DECAY * self.weights[k])).astype(np.float32)


def train_passages(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_passages: int = MAX_TRAIN_PASSAGES) -> AttentionModel | None:
    """The model from labels (doc_id, label 0/1) of docs; None if the sample lacks one of the two labels.

    The sample is bounded in documents and in passages.  An id with several labels has the least, one with
    several texts that with the smallest hash, so a rerun learns from the same rows."""

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                x, first = encode_passages(part.column(1))
                x = x.astype(np.float16)
                bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(first), pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "label", "_t", "size", "bag"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels.select("doc_id", F.col("label").cast("int").alias("label")), max_train)
    found = sample.mapInArrow(run, f"doc_id {id_type}, label int, _t long, size long, bag binary").groupBy("doc_id").agg(F.min(F.struct("_t", "label", "size", "bag")).alias("_x"))
    found = materialize(found.select("doc_id", "_x.label", "_x.size", "_x.bag"), "passages-sample")
    sizes = found.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    kept, total = [], 0
    for doc_id, size in zip(sizes.column("doc_id").to_pylist(), sizes.column("size").to_pylist()):
        if total + size <= max_passages:
            kept.append(doc_id)
            total += size
    if len(kept) < sizes.num_rows:
        found = found.join(F.broadcast(found.sparkSession.createDataFrame([(k,) for k in kept], f"doc_id {id_type}")), "doc_id")
    table = found.toArrow().sort_by("doc_id")
    y = np.asarray(table.column("label")).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, DIM) for chunk in table.column("bag").chunks for b in chunk]
    count, mean, square = 0, np.zeros(DIM), np.zeros(DIM)
    for bag in bags:
        count, mean, square = count + len(bag), mean + bag.sum(axis=0, dtype=np.float64), square + (bag.astype(np.float64) ** 2).sum(axis=0)
    mean /= count
    deviation = np.sqrt(np.maximum(square / count - mean**2, 0))
    model = AttentionModel.fresh(mean.astype(np.float32), np.maximum(deviation, 0.02).astype(np.float32))
    model.fit(bags, y)
    return model


def score_passages(docs: DataFrame, model: AttentionModel | None, *, passages: bool = False) -> DataFrame:
    """(doc_id, score) for each row of docs, and with `passages` the attention weight of each passage.

    A null or empty text is one passage without content and scored as such; without a model every score is
    1.  Repeated rows give equal rows; columns other than doc_id and text do not enter.
    """

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                x, first = encode_passages(part.column(1))
                if model is None:
                    score, weights = np.ones(part.num_rows), np.zeros(len(x))
                else:
                    s = model.forward(x, first)
                    score, weights = s["p"], s["a"]
                columns, names = [part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"]
                if passages:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(weights, pa.float32())))
                    names.append("attention")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double" + ", attention array<float>" * passages)


def keep_good(docs: DataFrame, model: AttentionModel | None, *, at: float = PREDICT_AT) -> DataFrame:
    """The rows of docs whose text scores `at` or more, whole and with all their columns, whatever their names; a
    null or empty text is scored as one passage without content, repeated rows alike.  Without a model all stay."""
    if model is None:
        return docs
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in tc.in_steps(batch, text, STEP_BYTES, STEP_ROWS):
                yield part.filter(pa.array(model.forward(*encode_passages(part.column(text)))["p"] >= at))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, by a model of labelled documents that aren't held out; see score_passages() for
    nulls, empties and repeats."""
    from .common import read

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = lambda: F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train_passages(docs, labels.where(~held()).select("doc_id", F.col("quality").alias("label")))
    out = score_passages(docs, model)
    return out.select("doc_id", F.coalesce(held(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
