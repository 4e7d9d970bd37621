"""Phrase collocation mining by Apriori level-wise passes.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and these into words.  Pass k counts, for
each language, the phrases of k words inside pieces: pass 1 all words, every later pass only phrases whose two
overlapping parts of k - 1 words are frequent, which the tasks know from the level before.  A level's table holds the
phrases found `least` times or more, so a frequent phrase is never missed: each of its parts is as frequent.  The
tables then give the counts of both sides of every cut, and the longer phrases that cover a shorter one.

What the passes broadcast is not the level's table, which grows with the corpus, but a bitmap of the hashes of its
phrases: 32 bits a phrase up to MAX_BITS in all, OR-ed together in Spark.  Two phrases on one bit let a phrase through
that is counted and then found rare; counts are of the words themselves, so a bitmap too small costs time and never a
result.  A task counts its texts in steps of bounded bytes and sends one row for each different phrase of a step, which
Spark adds up again before the shuffle, so a word or phrase with a third of all occurrences is a few rows a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textcore as tc
from .common import bounded, materialize, read

#: Occurrences that make a candidate, its most words, factor of the score, share (per cent) of a
#: phrase's occurrences inside a longer candidate from which it goes, phrases returned for a language.
LEAST, LONGEST, FACTOR, COVERED, KEEP = 30, 4, 2_000_000, 80, 2000
#: The language of texts without one.
UNKNOWN = "und"
#: Bits for each frequent phrase, and bits of a bitmap at most (32 MB).
BITS, MAX_BITS = 32, 1 << 28
#: Bytes of text counted at a time, unless a single text is longer.
STEP = 2 << 20

#: Bytes that end a piece, and those that end a word.
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
PARTS = BREAK.copy()
PARTS[[0x20, 0x09]] = True

_TURN = np.uint64(0x9E3779B97F4A7C15)


def _chain(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer than those hashed before."""
    return tc.mix(before * _TURN + words)


def _strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """Byte spans (ascending, not overlapping) as an Arrow array."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[begin] = 1
    edge[end] -= 1  # spans may touch
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])


class Words:
    """The words of a batch of texts: `number` of each among `distinct`, `language` of each among `languages`, whether
    the next one `follows` in its piece, and hashes of words and languages."""

    def __init__(self, texts: pa.Array, languages: pa.Array):
        raw, off, _ = tc.column_bytes(texts)
        raw = tc.LOWER[raw]
        begin, end, first = tc.spans(raw, off, PARTS)
        coded = _strings(raw, begin, end).dictionary_encode()
        self.distinct = coded.dictionary
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        breaks = np.cumsum(BREAK[raw], dtype=np.int32)
        self.follows = np.zeros(len(begin), bool)
        if len(begin):
            self.follows[:-1] = (breaks[begin[1:]] == breaks[end[:-1] - 1]) & (row[1:] == row[:-1])
        known = pc.fill_null(languages, UNKNOWN).cast(pa.string()).dictionary_encode()
        self.languages = known.dictionary
        self.language = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self._word_hash, self._language_hash = _hashes(self.distinct), _hashes(self.languages)

    def hashes(self, k: int) -> np.ndarray:
        """The hash of the phrase of k words from each word on (of no use where fewer words follow)."""
        word = self._word_hash[self.number] if len(self.number) else np.zeros(0, np.uint64)
        h = self._language_hash[self.language] if len(self.number) else word
        for j in range(k):
            h = _chain(h, np.concatenate([word[j:], word[:j]]))
        return h

    def starts(self, k: int) -> np.ndarray:
        """Whether k words of one piece begin here."""
        ok = np.ones(len(self.number), bool)
        for j in range(k - 1):
            ok &= np.concatenate([self.follows[j:], np.zeros(min(j, len(ok)), bool)])
        return ok


def _hashes(values: pa.Array) -> np.ndarray:
    raw, off, _ = tc.column_bytes(values)
    return tc.span_hashes(raw, off[:-1], off[1:])


def count_phrases(words: Words, k: int, seen: np.ndarray | None) -> tuple[list[pa.Array], np.ndarray]:
    """(language and the k words of each different phrase, how often it occurs) of those phrases whose parts of k - 1
    words are marked in the bitmap `seen`."""
    ok = words.starts(k)
    if seen is not None:
        marked = _marked(seen, words.hashes(k - 1))
        ok &= marked
        ok[:-1] &= marked[1:]
    at = np.flatnonzero(ok)
    d = max(len(words.distinct), 1)
    code = words.language[at] * d + words.number[at]
    levels = []
    for j in range(1, k):  # a number for each different beginning, so that codes stay within 64 bits
        held, inverse = np.unique(code, return_inverse=True)
        levels.append(held)
        code = inverse * d + words.number[at + j]
    held, times = np.unique(code, return_counts=True)
    parts = []
    for before in reversed(levels):
        parts.append(words.distinct.take(pa.array(held % d)))
        held = before[held // d]
    parts.append(words.distinct.take(pa.array(held % d)))
    return [words.languages.take(pa.array(held // d)), *reversed(parts)], times


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def level_bitmap(level: DataFrame, k: int, *, bits: int = BITS, most: int = MAX_BITS) -> np.ndarray:
    """The bitmap of a level's phrases (lang, phrase of k words): 64-bit words that Spark has OR-ed; what reaches the
    driver and the tasks is at most most / 8 bytes of bitmap, whatever the level's size."""
    size = 64
    while size < min(level.count() * bits, most):
        size *= 2

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                w = Words(batch.column(1), batch.column(0))
                first = np.flatnonzero(w.starts(k))  # a row is one phrase: it starts once
                bit = w.hashes(k)[first] & np.uint64(size - 1)
                yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = level.select("lang", "phrase").mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _level(docs: DataFrame, k: int, below: DataFrame | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of k words whose parts are frequent in the level below; for k = 1 also a row
    without phrase for each language, with the number of its words."""
    spark = docs.sparkSession
    seen = None if below is None else spark.sparkContext.broadcast(level_bitmap(below, k - 1))

    def count(batches):
        for batch in batches:
            for part in tc.in_steps(batch, 0, STEP, 1 << 30):
                words = Words(part.column(0), part.column(1))
                if not len(words.number):
                    continue
                (lang, *parts), times = count_phrases(words, k, None if seen is None else seen.value)
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "phrase", "f"])
                if k == 1:
                    n = np.bincount(words.language)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([words.languages.take(pa.array(at)), pa.nulls(len(at), pa.string()), pa.array(n[at], pa.int64())], names=["lang", "phrase", "f"])

    counted = docs.select(F.col("text").alias("text"), F.col("lang").alias("lang")).mapInArrow(count, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _cut(phrase, k: int):
    """The first k words of a phrase, and the rest."""
    words = F.split(phrase, " ")
    return F.concat_ws(" ", F.slice(words, 1, k)), F.concat_ws(" ", F.slice(words, k + 1, LONGEST + 1_000))


def _wide(c):
    return F.col(c).cast("decimal(38,0)")


def mine_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, keep: int = KEEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `keep` best phrases of 2 to `longest` words that occur
    `least` times or more (least is 1 at least).

    A null text has no words, a null lang is `und`; repeated rows count as often; texts without words and an empty
    table give no rows.  Further columns of docs do not enter, whatever their names.  Pieces of one word hold no phrase.
    A score is floor(2000000 a / (l + r)) of the cut with the lowest, in whole numbers of 38 digits.
    """
    docs = docs.select("text", "lang")
    words = materialize(_level(docs, 1, None), "phrases-1")
    levels = [words.where(F.col("phrase").isNotNull() & (F.col("f") >= least))]
    for k in range(2, longest + 1):
        levels.append(materialize(_level(docs, k, levels[-1]).where(F.col("f") >= least), f"phrases-{k}"))
    total = words.where("phrase is null").select("lang", F.col("f").alias("n"))

    counts = levels[0]
    for level in levels[1:-1]:
        counts = counts.unionByName(level)
    inside, cuts = [], []
    for k, level in enumerate(levels[1:], start=2):
        c = level.select("lang", "phrase", F.col("f").alias("a"))
        sides = F.array(*(F.struct(F.lit(j).alias("cut"), *(x.alias(n) for x, n in zip(_cut(F.col("phrase"), j), ("left", "right")))) for j in range(1, k)))
        cuts.append(c.select("lang", "phrase", "a", F.explode(sides).alias("c")).select("lang", "phrase", "a", "c.*"))
        split = F.split("phrase", " ")
        shorter = [F.concat_ws(" ", F.slice(split, i + 1, size)) for size in range(2, k) for i in range(k - size + 1)]
        if shorter:
            inside.append(level.select("lang", F.explode(F.array(*shorter)).alias("phrase"), "f"))
    cut = cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)

    def side(name: str, count: str) -> DataFrame:
        return bounded(counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)))

    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast({FACTOR} as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    if inside:
        longer = inside[0]
        for more in inside[1:]:
            longer = longer.unionByName(more)
        longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
        best = best.join(longer, ["lang", "phrase"], "left").where(F.col("_f").isNull() | (100 * _wide("_f") < covered * _wide("a")))
    found = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # first in parts, so that a language with most phrases is no single task: sqrt(phrases * keep) rows each, then as many
    some = sum(level.count() for level in levels[1:])
    parts = max(1, math.ceil(math.sqrt(some / max(keep, 1))))
    top = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for groups in (["lang", "_part"], ["lang"]):
        order = W.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return top.join(bounded(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark, sf_dir: str) -> DataFrame:
    """The best phrases of every language; see mine_phrases() for nulls, empties and repeats."""
    return mine_phrases(read(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level_sql(k: int) -> str:
    words = " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, k))])
    return f"g{k} AS (SELECT lang, {words} AS phrase FROM words WINDOW o AS (PARTITION BY doc, piece ORDER BY pos)), l{k} AS (SELECT lang, phrase, count(*) AS f FROM g{k} WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST})"


def _part(a: str, b: str) -> str:
    return f"array_to_string(string_split(phrase, ' ')[{a}:{b}], ' ')"


ORACLE = f"""WITH pieces AS (SELECT doc, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS text FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, '{UNKNOWN}') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)),
  words AS (SELECT doc, lang, piece, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM (SELECT doc, lang, piece, regexp_extract_all(text, '[^\\x20\\x09]+') AS t FROM pieces)),
  total AS (SELECT lang, count(*) AS n FROM words GROUP BY 1),
  {", ".join(_level_sql(k) for k in range(1, LONGEST + 1))},
  counts AS ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, LONGEST))}),
  found AS ({" UNION ALL ".join(f"SELECT *, {k} AS k FROM l{k}" for k in range(2, LONGEST + 1))}),
  cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut FROM found),
  sides AS (SELECT *, {_part("1", "cut")} AS lp, {_part("cut + 1", str(LONGEST))} AS rp FROM cuts),
  scored AS (SELECT s.lang, s.phrase, a, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f))::BIGINT AS score
    FROM sides s JOIN counts l ON l.lang = s.lang AND l.phrase = lp JOIN counts r ON r.lang = s.lang AND r.phrase = rp
    QUALIFY row_number() OVER (PARTITION BY s.lang, s.phrase ORDER BY score, cut) = 1),
  longer AS (SELECT lang, phrase, max(f) AS f FROM ({" UNION ALL ".join(f"SELECT lang, {_part(str(i), str(i + n - 1))} AS phrase, f FROM l{k}" for k in range(3, LONGEST + 1) for n in range(2, k) for i in range(1, k - n + 2))}) GROUP BY ALL),
  kept AS (SELECT s.* FROM scored s LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100::HUGEINT * g.f < {COVERED}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= {KEEP}"""
