"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents, and pass on any others, whatever
their names.  Repeated rows are rows of their own to every stage but the n-gram join, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, linededup, mixing, ngram_join, passages
from tessella.llm.common import materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model, learned from labels, does not reject; a null or empty text is scored as
    one passage without content."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return passages.keep_good(docs, passages.train_passages(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; no document goes, nulls and blank texts stay, and so do
    copies of whole pages, which the next stage thins out."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more); rows without a
    word or an id all stay."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources to their target weights; a document may stay twice, in part or not at all, and one
    without words has nothing to give."""
    return mixing.apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each text, and whether they decode to it; a null text has none."""
    ranks, pattern = bpe.default_vocabulary()
    coded = bpe.recode_documents(docs.select("doc_id", "text", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_utf8")), ranks, pattern, carry=("lang", "source", "_utf8"))
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", "lang", "source", n.alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_utf8")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: The classifier is learned, so SQL can't express the rows of run(); tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
