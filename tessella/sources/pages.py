"""Sources and sinks: page records, uploads, OCR results and the passage table."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import once, trim
from .records import list_records as resolve  # noqa: F401
from .records import read_records  # noqa: F401

#: Metadata that the passage table has as columns.
FLAT = ("source_type", "doc_title", "authority", "issue", "source_id")
#: Rendered pages, and bytes of them, that go on at a time.
PAGES, PAGE_BYTES = 1000, 8 << 20


def flatten(chunks: DataFrame) -> DataFrame:
    """Chunks with the flat metadata keys as columns, the whole map beside them."""
    return chunks.select("*", *(F.col("metadata")[k].alias(k) for k in FLAT))


def write_passages(passages: DataFrame, path: str, *, recreate: bool = False) -> None:
    """Append passages to the table, partitioned by source_type, or replace it."""
    passages.write.mode("overwrite" if recreate else "append").partitionBy("source_type").parquet(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of uploaded files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def render_pages(uploads: DataFrame, render, *, max_pages: int | None = 20, dpi: int = 250) -> DataFrame:
    """(path, page, image) of uploads by an injected renderer: render(bytes, dpi) yields images, which go on by about
    PAGES of them or PAGE_BYTES; all pages of an upload if max_pages is None."""

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for path, content in zip(*batch.columns):
                path = path.as_py()
                for i, image in enumerate(render(content.as_py(), dpi)):
                    if max_pages is not None and i >= max_pages:
                        break
                    out.append((path, i, image))
                    held += len(image)
                    if len(out) >= PAGES or held >= PAGE_BYTES:
                        yield _rendered(out)
                        out, held = [], 0
        if out:
            yield _rendered(out)

    return uploads.select("path", "content").mapInArrow(run, "path string, page int, image binary")


def _rendered(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=["path", "page", "image"])


def hull(points: Column) -> Column:
    """Struct x1, y1, x2, y2 around an array of [x, y] points; points of fewer than two numbers don't count
    and a polygon without any is an error."""

    def box(good: Column) -> Column:
        xs, ys = F.transform(good, lambda p: p[0].cast("double")), F.transform(good, lambda p: p[1].cast("double"))
        sides = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
        return F.when(F.size(good) > 0, sides).otherwise(F.raise_error(F.lit("polygon without points")).cast("struct<x1:double,y1:double,x2:double,y2:double>"))

    return once(F.filter(points, lambda p: F.size(p) >= 2), box)


def spotted_regions(texts: Column, polygons: Column) -> Column:
    """Array of (text, bbox, block_id) from parallel arrays; blank texts are left out (and not numbered),
    arrays of different length are an error."""
    # the numbers are compared once, not for each text
    texts = F.when(F.array_size(texts) != F.array_size(polygons), F.raise_error(F.lit("texts and polygons differ in number"))).otherwise(texts)
    both = F.filter(F.zip_with(texts, polygons, lambda t, p: F.struct(trim(t).alias("text"), p.alias("p"))), lambda x: x["text"] != "")
    return F.transform(both, lambda x, i: F.struct(x["text"].alias("text"), hull(x["p"]).alias("bbox"), i.alias("block_id")))


def parsed_regions(blocks: Column) -> Column:
    """Array of (text, bbox, label, block_id, block_order) of OCR blocks with content; a block without
    a number goes by its place."""
    numbered = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    full = F.filter(numbered, lambda x: F.coalesce(x["b"]["block_content"], F.lit("")) != "")

    def region(x: Column) -> Column:
        b, q = x["b"], x["b"]["block_bbox"]
        box = F.struct(q[0].cast("double").alias("x1"), q[1].cast("double").alias("y1"), q[2].cast("double").alias("x2"), q[3].cast("double").alias("y2"))
        label = F.coalesce(F.nullif(b["block_label"], F.lit("")), F.lit("text"))
        return F.struct(b["block_content"].alias("text"), box.alias("bbox"), label.alias("label"), F.coalesce(b["block_id"], x["i"]).alias("block_id"), b["block_order"].alias("block_order"))

    return F.transform(full, region)


def lines_of_words(words: DataFrame, page: list[str]) -> DataFrame:
    """Words (block, par, line, word, text, x1, y1, x2, y2, conf) to lines: text by spaces in order of word,
    the box around them, the mean confidence of those that have one (not negative), null if none has."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*page, "block", "par", "line").agg(text.alias("text"), *(F.min(c).alias(c) for c in ("x1", "y1")), *(F.max(c).alias(c) for c in ("x2", "y2")), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf"))


def merge_uploads(files: DataFrame, capacity: int, *, max_bytes: int, suffixes: tuple[str, ...]) -> DataFrame:
    """files (session, position, existing, name, size, modified) with verdict: existing files are kept; of the
    new ones, in order, extension, size, duplicate (of anything kept before) and limit reject, and only
    what is taken uses capacity."""
    ok = F.lower("name").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    first = F.when(F.col("existing"), "existing").when(~ok, "extension").when(F.col("size") > max_bytes, "size")
    f = files.withColumn("_v", first).withColumn("_key", F.concat_ws(":", "name", F.col("size").cast("string"), F.col("modified").cast("string")))
    f = f.withColumn("_c", F.coalesce(F.col("_v") == "existing", F.lit(True)))  # may hold or take the key
    seen = W.partitionBy("session", "_key", "_c").orderBy(F.col("existing").desc(), "position")
    f = f.withColumn("_v", F.when(F.col("_v").isNull() & (F.row_number().over(seen) > 1), "duplicate").otherwise(F.col("_v")))
    took = W.partitionBy("session").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    n = F.sum(F.col("_v").isNull().cast("int")).over(took)
    # what the limit turns away was never taken, so its repeats are turned away by the limit too
    f = f.withColumn("_n", n).withColumn("_v", F.when(F.col("_v").isNull() & (F.col("_n") > capacity), "limit").otherwise(F.col("_v")))
    lost = W.partitionBy("session", "_key", "_c")
    f = f.withColumn("_v", F.when((F.col("_v") == "duplicate") & F.max(F.col("_v") == "limit").over(lost), "limit").otherwise(F.col("_v")))
    return f.withColumn("verdict", F.coalesce("_v", F.lit("taken"))).drop("_v", "_key", "_c", "_n")


def rejection_notices(rejected: DataFrame, reasons: tuple[str, ...] = ("extension", "size", "limit", "duplicate")) -> DataFrame:
    """(session, place, reason, target) of rejected files, by reason in the stated order: the first name, and
    how many more."""
    names = F.array_sort(F.collect_list(F.struct("position", "name")))
    r = rejected.where(F.col("verdict").isin(*reasons)).groupBy("session", F.col("verdict").alias("reason")).agg(names.alias("_n"))
    first = F.element_at("_n", 1)["name"]
    place = F.array_position(F.array(*map(F.lit, reasons)), F.col("reason"))
    return r.select("session", place.alias("place"), "reason", F.when(F.size("_n") == 1, first).otherwise(F.concat(first, F.lit(" +"), (F.size("_n") - 1).cast("string"))).alias("target"))


_BLOCKS = "array<struct<block_content:string,block_bbox:array<double>,block_label:string,block_id:int,block_order:int>>"
_SPOTS = "struct<rec_texts:array<string>,rec_polys:array<array<array<double>>>>"
_RESULT = f"struct<page_index:int,width:int,height:int,parsing_res_list:{_BLOCKS},spotting_res:{_SPOTS}>"


def ocr_page(payload: Column, default_page: Column) -> Column:
    """Struct (page_index, width, height, regions) of an OCR result in JSON, plain or under `res`: spotted
    regions, or where there are none the blocks; a missing page number is the default."""
    data = F.coalesce(F.from_json(payload, f"struct<res:{_RESULT}>")["res"], F.from_json(payload, _RESULT))
    spots = data["spotting_res"]
    both = "array<struct<text:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,label:string,block_id:int,block_order:int>>"
    found = F.when(spots.isNotNull(), spotted_regions(F.coalesce(spots["rec_texts"], F.array().cast("array<string>")), F.coalesce(spots["rec_polys"], F.array().cast("array<array<array<double>>>"))))
    spotted = F.transform(found, lambda r: F.struct(r["text"].alias("text"), r["bbox"].alias("bbox"), F.lit("spotting").alias("label"), r["block_id"].alias("block_id"), F.lit(None).cast("int").alias("block_order"))).cast(both)
    blocks = parsed_regions(F.coalesce(data["parsing_res_list"], F.array().cast(_BLOCKS))).cast(both)
    regions = F.when(F.coalesce(F.size(spotted), F.lit(-1)) > 0, spotted).otherwise(blocks)
    return F.struct(F.coalesce(data["page_index"], default_page).alias("page_index"), F.coalesce(data["width"], F.lit(0)).alias("width"), F.coalesce(data["height"], F.lit(0)).alias("height"), regions.alias("regions"))


def find_folder(name: str, start: str) -> str:
    """The folder of this name, as it stands or below `start` or a folder above it, nearest first."""
    from pathlib import Path

    at = Path(start).resolve()
    for folder in [Path(name), *(base / name for base in (at, *at.parents))]:
        if folder.exists():
            return str(folder)
    raise FileNotFoundError(name)


def read_images(images: DataFrame, engine) -> DataFrame:
    """(doc_id, page, region, text) of page images (doc_id, page, image) as the OCR engine, an argument (image bytes
    to texts of regions in reading order), gives them; a page without an image or a text has none."""

    def run(frames):
        for f in frames:
            out = [(d, p, i, t) for d, p, b in f.itertuples(index=False) if b is not None for i, t in enumerate(engine(bytes(b)))]
            yield pd.DataFrame(out, columns=["doc_id", "page", "region", "text"])

    kind = images.schema["doc_id"].dataType.simpleString()
    return images.select("doc_id", "page", "image").mapInPandas(run, f"doc_id {kind}, page int, region int, text string")
