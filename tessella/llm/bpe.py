"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Spark partitions the documents; inside a task each pre-token is encoded by merging the adjacent pair of
lowest rank, leftmost first, until none is in the vocabulary.  Candidate pairs wait in buckets by rank;
a two-level bitmap tells which buckets hold something, so the next rank is found by two find-first-set
steps however long the pre-token is.  Parts form a doubly linked list by position; an entry whose pair
has changed since is stale and skipped.  A pre-token of n bytes costs O(n log n).  The distinct new
pre-tokens of a batch share one queue, whose buckets are merged with numpy; very long ones get their own.

The vocabulary (under 1 MB) is read once on the driver and travels with the task; each worker keeps a
bounded cache of encoded pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import in_steps

#: Distinct pre-tokens a worker remembers; those with ids of more than CACHE_BYTES are not remembered.
CACHE_SIZE = 250_000
CACHE_BYTES = 64
#: Bytes of text encoded together, and the most rows.
BATCH_BYTES, BATCH_ROWS = 2_000_000, 10_000

#: Pre-tokens above this many bytes are merged one by one, the others of a batch together.
LONG_BYTES = 128

LEAF = 256  # ranks under one bit of the upper level


def load_ranks(path: str) -> bytes:
    """The rank file, compressed, as tasks get it."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 6)


class RankQueue:
    """Positions by rank: a bucket for each rank that has some, and a two-level bitmap of those ranks."""

    def __init__(self) -> None:
        self.upper = 0
        self.leaves: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        high = rank // LEAF
        self.leaves[high] = self.leaves.get(high, 0) | 1 << rank % LEAF
        self.upper |= 1 << high

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its bucket, which is taken out."""
        if not self.upper:
            return None
        high = (self.upper & -self.upper).bit_length() - 1
        leaf = self.leaves[high]
        rank = high * LEAF + (leaf & -leaf).bit_length() - 1
        leaf &= leaf - 1
        if leaf:
            self.leaves[high] = leaf
        else:
            del self.leaves[high]
            self.upper &= self.upper - 1
        return rank, self.buckets.pop(rank)


def _letters_pattern() -> str:
    """The classes of the usual pre-token pattern, spelled out for code points below U+0250."""
    known = [chr(i) for i in range(0x250)]
    letters = "".join(c for c in known if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in known if unicodedata.category(c)[0] == "N")
    space = r"\t-\r \x85\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


class Codec:
    """Encoder and decoder of one vocabulary: ranks of byte strings, and the pattern of pre-tokens."""

    def __init__(self, packed: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, zlib.decompress(packed).splitlines())}
        self.split = regex.compile(pattern).findall
        usual = pattern == r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.split_latin = re.compile(_letters_pattern()).findall if usual else None
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.byte_rank = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.width = size + 1
        pairs = sorted((self.ranks[t[:i]] * self.width + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pair_key = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_rank = np.array([r for _, r in pairs] + [-1], np.int64)
        self.cache: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they do not merge (or one is -1)."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def merge_one(self, data: bytes) -> list[int]:
        """Ids of one pre-token, however long."""
        ranks = self.ranks
        n = len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that begins at a position now
        queue = RankQueue()
        for i in range(n - 1):
            if (rank := ranks.get(data[i : i + 2])) is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (top := queue.pop()) is not None:
            rank, bucket = top
            heapify(bucket)
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                pair[gone] = pair[i] = -1
                fresh = [i]
                if end < n:
                    before[end] = i
                if before[i] >= 0:
                    fresh.append(before[i])
                lowest = rank
                for j in fresh:
                    right = after[j]
                    pair[j] = ranks.get(data[j : after[right]], -1) if right < n else -1
                    if pair[j] == rank:
                        heappush(bucket, j)
                    elif pair[j] >= 0:
                        queue.push(pair[j], j)
                        lowest = min(lowest, pair[j])
                if lowest < rank:  # a lower rank has come up: the rest of the bucket waits
                    for j in bucket:
                        queue.push(rank, j)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens (none empty), all in one queue: the bucket of the lowest rank is merged in
        all of them at once, at its leftmost place in each."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        ends = np.cumsum(lengths)
        token = np.append(self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        word = np.repeat(np.arange(len(pieces)), lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - lengths] = n
        pair = np.append(self.ranks_of(token[:-1], token[after[:-1]]), -1)
        queue = RankQueue()
        some = np.flatnonzero(pair >= 0)
        for rank, position in zip(pair[some].tolist(), some.tolist(), strict=True):
            queue.push(rank, position)
        while (top := queue.pop()) is not None:
            rank, bucket = top
            at = np.array(bucket)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at.sort()
                rest = word[at[1:]] == word[at[:-1]]
                if rest.any():
                    for position in at[1:][rest].tolist():
                        queue.push(rank, position)
                    at = at[np.concatenate([[True], ~rest])]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            token[at], token[gone] = rank, -1
            after[at], before[end] = end, at
            left = before[at]
            left = left[left < n]
            pair[gone] = -1
            fresh = np.concatenate([at, left])
            found = self.ranks_of(token[fresh], token[after[fresh]])
            pair[fresh] = found
            some = found >= 0
            for r, position in zip(found[some].tolist(), fresh[some].tolist(), strict=True):
                queue.push(r, position)
        kept = token[:-1] >= 0
        ids = token[:-1][kept].astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.bincount(word[kept], minlength=len(pieces)))).tolist()
        return [ids[a:b] for a, b in zip([0, *stop], stop)]

    def pieces(self, text: str) -> list[str]:
        if self.split_latin is not None and (text.isascii() or max(text) < "\u0250"):
            return self.split_latin(text)
        return self.split(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(cache)
        short, found = [], {}
        for piece in new:
            data = piece.encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                found[piece] = whole.to_bytes(4, "little")
            elif len(data) > LONG_BYTES:
                found[piece] = np.array(self.merge_one(data), "<u4").tobytes()
            else:
                short.append((piece, data))
        if short:
            found |= zip((p for p, _ in short), self.merge_many([d for _, d in short]), strict=True)
        if len(cache) + len(found) > CACHE_SIZE:
            held = cache | found
            cache.clear()
        else:
            cache |= {k: v for k, v in found.items() if len(v) <= CACHE_BYTES}
            held = cache if all(k in cache for k in found) else cache | found
        return [b"".join(map(held.__getitem__, p)) for p in split]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        token = np.frombuffer(ids, "<u4")
        length = self.token_length[token]
        end = np.cumsum(length)
        at = np.repeat(self.token_start[token] - (end - length), length) + np.arange(end[-1] if len(end) else 0)
        return self.token_bytes[at].tobytes()


_CODECS: dict[bytes, Codec] = {}


def _codec(packed: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(packed + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(packed, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids): ids of each row's text as little-endian unsigned 32-bit integers in one binary value.

    A null text counts as empty and has no ids.  Every row of docs gives one row; repeated rows give
    equal ones; other columns of docs do not enter.
    """

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in in_steps(batch, 1, BATCH_BYTES, BATCH_ROWS):
                ids = codec.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "value"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").alias("value")).mapInArrow(run, f"doc_id {id_type}, value binary")
    return out.withColumnRenamed("value", "ids")


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for, beside them."""

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = pa.array([codec.decode(v.as_py() or b"") for v in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=["doc_id", "ids", "decoded"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def recode_documents(docs: DataFrame, ranks: bytes, pattern: str, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, decoded) and the columns in carry: encode_documents and decode_documents in one pass of
    one worker."""

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in in_steps(batch, 1, BATCH_BYTES, BATCH_ROWS):
                ids = codec.encode_batch([t or "" for t in part.column(1).to_pylist()])
                decoded = pa.array([codec.decode(v) for v in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), decoded, *part.columns[2:]], names=["doc_id", "ids", "decoded", *carry])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    more = "".join(f", {c} {kind(c)}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(run, f"doc_id {kind('doc_id')}, ids binary, decoded binary{more}")


def default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def digest(coded: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token ids, by their digests, and what they decode to; a null text counts as empty, repeats give equal rows."""
    from .common import read

    ranks, pattern = default_vocabulary()
    return digest(recode_documents(read(spark, sf_dir, "documents"), ranks, pattern))
