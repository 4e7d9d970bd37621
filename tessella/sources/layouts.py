"""Tables laid out for the service's reads: what a partial index is to a row store, as data skipping.

A layout holds the rows that meet its predicate, ranged by its columns over files and sorted within them, so that each
file (and each row group, whose minima and maxima Parquet keeps) covers a short range.  Beside the files lies their map:
for each file the first and last row and the number of rows.  A read for one owner picks files from the map, newest
first, and opens no more of them than its page needs; the filter is pushed into them as well.  Keys that are looked up
by equality get bloom filters.

A range that is one value (an owner with a third of all rows) is cut by the next column, so it lies in many files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs, relational


@dataclass(frozen=True)
class Layout:
    """Rows that meet `where`, in order of `order`; `bloom` are columns looked up by equality."""

    where: str
    order: tuple[str, ...]
    bloom: tuple[str, ...] = ()


_ACTIVE = " or ".join(f"status = '{s}'" for s in jobs.ACTIVE)
#: The service's layouts.  `active` is the queue's own view: it holds jobs that their owner has deleted as well.
NOTES = {
    "alive": Layout("deleted_at is null", ("user_id", "created_at", "id")),
    "unread": Layout("deleted_at is null and read_at is null", ("user_id", "created_at", "id")),
    "dedupe": Layout("dedupe_key is not null", ("user_id", "dedupe_key"), ("dedupe_key",)),
}
JOBS = {
    "alive": Layout("deleted_at is null", ("user_id", "queued_at", "job_id")),
    "queue": Layout("status = 'QUEUED'", ("queued_at", "job_id")),
    "lease": Layout("status = 'RUNNING'", ("lease_until", "job_id")),
    "active": Layout(_ACTIVE, ("user_id", "queued_at", "job_id")),
}
#: Rows of a file and of a row group, about.
FILE_ROWS, GROUP_BYTES = 1_000_000, 8 << 20


def write_layout(rows: DataFrame, layout: Layout, path: str, *, file_rows: int = FILE_ROWS) -> None:
    """Writes a layout of rows, `rows` and `map`, to the folder path."""
    spark = rows.sparkSession
    mine = rows.where(layout.where)
    files = max(1, -(-mine.count() // file_rows))
    out = mine.repartitionByRange(files, *layout.order).sortWithinPartitions(*layout.order).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES)
    for c in layout.bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(f"{path}/rows")
    held = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    key = F.struct(*layout.order)
    spans = held.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    spans.write.mode("overwrite").parquet(f"{path}/map")


def files_of(spark: SparkSession, layout: Layout, path: str, owner, before: tuple | None = None) -> DataFrame:
    """The map's rows of files that may hold rows of an owner (the first column of the order), of those up to the
    cursor `before` (the second and third) if given, newest first."""
    a, b, c = layout.order
    found = spark.read.parquet(f"{path}/map").where((F.col(f"first.{a}") <= owner) & (F.col(f"last.{a}") >= owner))
    if before is not None:
        kind = found.schema["first"].dataType[b].dataType
        later = (F.col(f"first.{a}") == owner) & (F.col(f"first.{b}") > F.lit(before[0]).cast(kind))
        found = found.where(~F.coalesce(later, F.lit(False)))
    return found.orderBy(F.col("last").desc())


def owner_page(spark: SparkSession, layout: Layout, path: str, schema, owner, *, limit: int | None = None, cursor: tuple | None = None) -> DataFrame:
    """The page of an owner's rows after the cursor, as keyset_page() gives it, from as few files as it needs: one, then
    twice as many each time until the page is full or no file is left."""
    _, ts, key = layout.order
    limit = relational.PAGE if limit is None else max(1, min(limit, relational.MAX_PAGE))
    files, take = files_of(spark, layout, path, owner, cursor), 1
    empty = spark.createDataFrame([], schema)
    while True:
        names = [r["file"] for r in files.limit(take + 1).collect()]
        rows = spark.read.schema(schema).parquet(*names[:take]) if names else empty
        page = relational.keyset_page(rows.where(F.col(layout.order[0]) == owner), ts, key, limit, cursor)
        if len(names) <= take:
            return page
        got = page.select("has_more").limit(1).collect()
        if got and got[0][0]:  # limit + 1 rows lie in these files, and no other file has newer ones
            return page
        take *= 2


def oldest(spark: SparkSession, layout: Layout, path: str, schema, n: int = 1) -> DataFrame:
    """The first n rows in the layout's order (a queue's next jobs), from the first files that hold as many."""
    spans = spark.read.parquet(f"{path}/map").orderBy("first").limit(n).collect()
    names, held = [], 0
    for r in spans:
        if held < n:
            names.append(r["file"])
            held += r["n"]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return rows.orderBy(*layout.order).limit(n)


def lookup(spark: SparkSession, layout: Layout, path: str, schema, **values) -> DataFrame:
    """Rows whose columns equal the values; the map, row group ranges and bloom filters skip what can't hold them."""
    first = layout.order[0]
    spans = spark.read.parquet(f"{path}/map")
    if first in values:
        spans = spans.where((F.col(f"first.{first}") <= values[first]) & (F.col(f"last.{first}") >= values[first]))
    names = [r[0] for r in spans.select("file").collect()]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    for c, v in values.items():
        rows = rows.where(F.col(c) == v)
    return rows
