"""JSON-line records from files that are read in many splits, with stable line numbers, and the same as a stream.

A file's splits are numbered by their first byte.  One pass counts the lines (and the records) of each split; a line's
number is then the lines of the splits before it and its place in its own, so no text is shuffled and no file is one
task.  A limit of records a file is taken the same way: splits wholly inside it stay as they are, and only the split in
which it falls is numbered record by record.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

_META = "map<string,string>"


def _parsed(lines: DataFrame) -> DataFrame:
    """lines (value, ...) with _object (whether the line is one), content and metadata."""
    out = lines.withColumn("_line", strip(F.col("value"))).withColumn("_j", F.try_parse_json("_line"))
    ok = F.coalesce(F.schema_of_variant("_j").startswith("OBJECT"), F.lit(False))
    content = strip(F.coalesce(F.try_variant_get("_j", "$.page_content", "string"), F.lit("")))
    meta = F.coalesce(F.try_variant_get("_j", "$.metadata", _META), F.create_map().cast(_META))
    return out.withColumns({"_object": ok, "content": content, "metadata": meta})


def _record() -> Column:
    return F.col("_object") & (F.col("content") != "")


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths)
    # the number grows along a split's lines, one by one
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.monotonically_increasing_id().alias("_n"))


def _before(c: str) -> Column:
    """The sum over the file's earlier splits."""
    return F.coalesce(F.sum(c).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, split, line_no from 1, value) of all lines."""
    lines = _numbered(spark, paths)
    spans = lines.groupBy("file", "split").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    spans = spans.select("file", "split", "_first", _before("_lines").alias("_before"))  # a row for each split
    return lines.join(spans, ["file", "split"]).select("file", "split", (F.col("_before") + F.col("_n") - F.col("_first") + 1).alias("line_no"), "value")


def read_records(spark: SparkSession, paths: list[str], *, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines {page_content, metadata}: records are (file, line_no, content, metadata as a map
    of strings), rejects (file, line_no, line).  Blank lines and records without content are neither; lines that are no
    JSON object are rejects.  `limit` is for the records of each file, the first by line."""
    parsed = _parsed(read_lines(spark, paths)).where("_line <> ''")
    records = parsed.where(_record())
    if limit is not None:
        spans = records.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_records"))
        spans = spans.select("file", "split", (F.lit(limit) - _before("_records")).alias("_left"), "_records").where("_left > 0")
        records = records.join(spans, ["file", "split"])
        cut = records.where("_left < _records")  # one split a file at most
        nth = F.row_number().over(W.partitionBy("file", "split").orderBy("line_no"))
        records = records.where("_left >= _records").unionByName(cut.withColumn("_nth", nth).where("_nth <= _left").drop("_nth"))
    return records.select("file", "line_no", "content", "metadata"), parsed.where("not _object").select("file", "line_no", F.col("_line").alias("line"))


def stream_records(spark: SparkSession, folder: str, *, files_a_trigger: int = 100) -> DataFrame:
    """Records (file, content, metadata, reject) of the *.jsonl files that come into a folder; `reject` is the line that
    is no JSON object, and its content is empty."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "*.jsonl").text(folder)
    parsed = _parsed(lines.select(F.col("_metadata.file_path").alias("file"), "value")).where("_line <> ''")
    rows = parsed.select("file", F.when(F.col("_object"), F.col("content")).otherwise("").alias("content"), "metadata", F.when(~F.col("_object"), F.col("_line")).alias("reject"))
    return rows.where("content <> '' or reject is not null")


def list_records(spark: SparkSession, folder: str, names: str | None = None) -> list[str]:
    """Paths of the named files (comma-separated; a missing one is an error), else of all *.jsonl in the folder by name
    (none is an error), as Spark's own file listing gives them."""
    try:
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl" if not names else "*").load(folder).select("path")
        at = {p.rsplit("/", 1)[1]: p for (p,) in there.collect()}  # the names of a folder
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        at = {}
    wanted = [n.strip() for n in names.split(",") if n.strip()] if names else sorted(at)
    missing = [n for n in wanted if n not in at]
    if missing or not wanted:
        raise FileNotFoundError(", ".join(missing) or f"no .jsonl file in {folder}")
    return [at[n] for n in wanted]
