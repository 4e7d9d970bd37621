"""End-to-end jobs: page records to a passage table, and OCR regions to contract reports.

Models are arguments: an embedder takes a list of texts and gives as many unit vectors of one dimension.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pii, rules, scalars, text
from ..operators import relational
from ..sources import pages

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 64


def hash_embedder(dim: int = 32) -> Embedder:
    """A deterministic stand-in: words hashed into `dim` signed cells, to unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return run


def embed(c: Column, embedder: Embedder, dim: int) -> Column:
    """Vectors of texts, BATCH at a time; a vector of another dimension is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = [v for at in range(0, len(s), BATCH) for v in embedder(s.iloc[at : at + BATCH].tolist())]
            if any(len(v) != dim for v in got):
                raise ValueError(f"vectors of another dimension than {dim}")
            yield pd.Series(got, index=s.index)

    return run(c)


def ingest(spark: SparkSession, paths: list[str], table: str, embedder: Embedder, dim: int, *, recreate: bool = False) -> DataFrame:
    """Page records to the passage table at `table`; returns the rejected lines."""
    records, rejects = pages.read_records(spark, paths)
    m = lambda k: F.col("metadata")[k]
    header = text.page_header(F.coalesce(m("doc_title"), F.lit("")), m("doc_year"), [m("book_page"), m("pdf_page"), m("page_index")])
    chunks = text.chunk_pages(records.select("content", "metadata"), header)
    chunks = pages.flatten(chunks.withColumn("embedding", embed(F.col("embed_text"), embedder, dim)).drop("embed_text"))
    pages.write_passages(chunks.withColumn("source_type", F.coalesce("source_type", F.lit("unknown"))), table, recreate=recreate)
    return rejects


def report(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected) of OCR regions (doc_id, page, region, text): mask, pass the gate, read terms and
    risks, and roll them up to a level and a score."""
    masked = pii.mask_regions(regions)
    passed, rejected = pii.gate(masked)
    counts = relational.merge_counts(masked, ["doc_id"], "counts").withColumnRenamed("counts", "redaction_counts")
    out = rules.analyze(passed)
    n = lambda level: F.size(F.filter("risks", lambda r: r["severity"] == level))
    worst = F.coalesce(F.array_max(F.transform("risks", lambda r: scalars.severity_rank(r["severity"]))), F.lit(0))
    out = out.withColumn("risk_level", scalars.risk_level(worst)).withColumn("score", scalars.safety_score(n("HIGH"), n("MEDIUM"), n("LOW")))
    out = out.withColumn("label", scalars.safety_label(F.col("score"))).join(counts, "doc_id", "left")
    return out.withColumn("redaction_scope", F.array(*map(F.lit, pii.KINDS))), rejected
