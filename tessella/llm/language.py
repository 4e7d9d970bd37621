"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a run of three letters (or word edges) is the product of
its letters' vectors, permuted by place; a text is the sum of its runs.  A language's prototype is the
sum of the unit vectors of its labelled texts, and a text's language is the prototype with the largest
cosine.  Prototypes are learned from a bounded sample; scoring is one matrix product per Arrow slice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import in_steps

DIM = 512
#: Classes of letters: 0 is whatever is no letter, 1-26 are a-z, the others share the rest by code point.
CLASSES = 128
SEED = 7
#: Labelled rows that prototypes are learned from, at most (those with the smallest hash of their id).
MAX_TRAIN = 12_000
STEP_BYTES, STEP_ROWS = 1_000_000, 384
#: Characters that are counted at a time, and distinct runs that are multiplied at a time.
PIECE, RUNS = 500_000, 4096

_STATE: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """Class of every code point; letters of either case share one."""
    if "classes" not in _STATE:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = ord(c.lower()[0])
                table[i] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
        _STATE["classes"] = table
    return _STATE["classes"]


def _letter_vectors() -> np.ndarray:
    if "letters" not in _STATE:
        _STATE["letters"] = np.random.RandomState(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIM))
    return _STATE["letters"]


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """Vectors of runs of three classes: each letter's vector rolled by its distance from the end, multiplied."""
    v = _letter_vectors()
    a, b, c = runs // CLASSES**2, runs // CLASSES % CLASSES, runs % CLASSES
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str, str, str]]]:
    """Lists of (row, character before, piece, character after) that cover the texts, of about PIECE characters each."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t or ""), PIECE):
            piece = t[a : a + PIECE]
            held.append((i, t[a - 1] if a else "", piece, t[a + PIECE : a + PIECE + 1]))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the texts, whether each has a letter); the vector of a text without runs is 0.

    Texts are counted a piece and multiplied RUNS distinct runs at a time, so memory does not grow with
    their length; sums are whole numbers, so pieces and company do not change them."""
    out, has = np.zeros((len(texts), DIM)), np.zeros(len(texts), bool)
    for pieces in _pieces(texts):
        rows = np.array([p[0] for p in pieces])
        lengths = np.array([len(p[2]) for p in pieces])
        # each piece between the characters beside it; a word edge stands before the first and after the last letter of a text
        points = np.frombuffer("".join((b or "\0") + t + (a or "\0") for _, b, t, a in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letter_classes()[points].astype(np.int32)
        owner = np.repeat(np.arange(len(pieces)), lengths + 2)
        first = np.cumsum(lengths + 2) - (lengths + 2)
        middle = np.ones(len(points), bool)
        middle[first] = middle[first + lengths + 1] = False
        at = np.flatnonzero(middle & (kind > 0))
        if not len(at):
            continue
        has[rows[owner[at]]] = True
        runs = (kind[at - 1] * CLASSES + kind[at]) * CLASSES + kind[at + 1]
        cell, count = np.unique(runs.astype(np.int64) * len(pieces) + owner[at], return_counts=True)
        run, piece = cell // len(pieces), cell % len(pieces)
        distinct = np.unique(run)
        for b in range(0, len(distinct), RUNS):
            some = distinct[b : b + RUNS]
            mine = slice(np.searchsorted(run, some[0]), np.searchsorted(run, some[-1], "right"))
            counts = np.zeros((len(pieces), len(some)), np.float32)
            counts[piece[mine], np.searchsorted(some, run[mine])] = count[mine]
            np.add.at(out, rows, counts @ run_vectors(some).astype(np.float32))
    norm = np.sqrt((out**2).sum(axis=1))
    return out / np.maximum(norm, 1e-9)[:, None], has


def training_rows(labelled: DataFrame, max_train: int) -> DataFrame:
    """(text, lang) of at most max_train rows of labelled (doc_id, text, lang), those whose id has the smallest hash;
    rows that repeat an id, a text and a lang count once, and of more texts of one id come those with the smallest hash."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"), "lang")
    # ids below a hash that about twice as many have as are wanted: a repeated id takes no other's place
    n = known.agg(F.approx_count_distinct("_h")).first()[0]
    edge = min(-(1 << 63) + int((1 << 64) * min(1.0, 2.0 * max_train / max(n, 1))), (1 << 63) - 1)
    few = known.where(F.col("_h") <= F.lit(edge)).distinct().orderBy("_h", "_t", "lang").limit(max_train)
    few = F.broadcast(few.withColumnsRenamed({"lang": "_l"}))
    same = (F.xxhash64("doc_id") == F.col("_h")) & (F.xxhash64("text") == F.col("_t")) & (F.col("lang") == F.col("_l"))
    return labelled.join(few, same).dropDuplicates(["_h", "_t", "_l"]).select("text", "lang")


def learn_prototypes(labelled: DataFrame, *, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from labelled (doc_id, text, lang); rows with a null lang or text do not
    enter, and of the others at most max_train (see training_rows).  Sums are of whole numbers, so they do
    not depend on the order of tasks."""

    def run(batches):
        for batch in batches:
            for part in in_steps(batch, 0, STEP_BYTES, STEP_ROWS):
                vectors, has = text_vectors(part.column(0).to_pylist())
                langs = part.column(1).to_pylist()
                for lang in dict.fromkeys(langs):
                    mine = np.array([x == lang for x in langs]) & has
                    total = np.rint(vectors[mine] * 1e6).astype(np.int64).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "total"])

    parts = training_rows(labelled, max_train).mapInArrow(run, "lang string, total array<long>")
    sums: dict[str, np.ndarray] = {}
    for r in parts.collect():  # a row for each slice of the bounded sample and language
        sums[r.lang] = sums.get(r.lang, 0) + np.array(r.total, np.int64)
    names = sorted(k for k, v in sums.items() if np.any(v))
    if not names:
        return [], np.zeros((0, DIM))
    m = np.array([sums[k] for k in names], np.float64)
    return names, m / np.linalg.norm(m, axis=1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs; score is (1 + cosine) / 2.

    A text that is null or has no letter is `und` with score 0, as is every text if no language was
    learned; languages with equal cosines go by name.  Repeated rows give equal rows; columns other than
    doc_id and text do not enter.
    """
    names, prototypes = model

    def run(batches):
        for batch in batches:
            for part in in_steps(batch, 1, STEP_BYTES, STEP_ROWS):
                vectors, has = text_vectors(part.column(1).to_pylist())
                if names:
                    cosine = np.round(vectors @ prototypes.T, 9)
                    best = cosine.argmax(axis=1)
                    lang = [names[b] if ok else "und" for b, ok in zip(best, has)]
                    score = np.where(has, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1), 0.0)
                else:
                    lang, score = ["und"] * len(has), np.zeros(len(has))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, by prototypes of those that aren't held out; see identify() for nulls,
    texts without letters and repeats."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn_prototypes(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
