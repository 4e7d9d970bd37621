"""Corpus diagnostics: counts, length statistics, histograms and chunking grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summary(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(source).alias("n_sources"))


def by_source(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), source)


def quantiles(lengths: DataFrame, group: list[str], at: tuple[int, ...] = (90, 99)) -> DataFrame:
    """Exclusive percentiles of `length` in each group: at p (n + 1) / 100, interpolated, with the lower
    neighbour held between the first and the last but one (one value is every percentile).

    Lengths are counted first; ranks come from running sums over distinct lengths, which a text limit
    bounds, so no group's values are gathered.
    """
    return counted_quantiles(lengths.groupBy(*group, "length").agg(F.count(F.lit(1)).alias("c")), group, at)


def counted_quantiles(c: DataFrame, group: list[str], at: tuple[int, ...] = (90, 99), more: tuple[Column, ...] = ()) -> DataFrame:
    """quantiles() of lengths that are counted already, in c (group, length, c); a null length has a count of 0.
    `more` are further aggregates of these rows."""
    run = W.partitionBy(*group).orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("hi", F.sum("c").over(run)).withColumn("n", F.sum("c").over(W.partitionBy(*group)))
    c = c.withColumn("lo", F.col("hi") - F.col("c"))
    value = lambda rank: F.max(F.when((F.col("lo") < rank) & (rank <= F.col("hi")), F.col("length")))
    out = []
    for p in at:
        j = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * p / 100), F.col("n") - 1))
        out += [value(j).alias(f"_a{p}"), value(F.least(j + 1, F.col("n"))).alias(f"_b{p}")]
    mid, up = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    total = F.sum(F.col("length") * F.col("c"))
    got = c.groupBy(*group).agg(F.max("n").alias("n"), F.min("length").alias("min"), F.max("length").alias("max"), total.alias("_sum"), value(mid).alias("_m"), value(up).alias("_u"), *out, *more)
    cols = [*group, "n", "min", F.floor((F.col("_m") + F.col("_u")) / 2).cast("long").alias("p50"), F.bround(F.col("_sum") / F.col("n"), 1).alias("mean")]
    for p in at:
        j = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * p / 100), F.col("n") - 1))
        rest = (F.col("n") + 1) * p - j * 100
        cols.append(F.round((F.col(f"_a{p}") * (100 - rest) + F.col(f"_b{p}") * rest) / 100, 1).alias(f"p{p}"))
    return got.select(*cols, "max", *got.columns[len(got.columns) - len(more) :])


def histogram(lengths: DataFrame, bins: int = 12) -> DataFrame:
    """(bin, n) of equal bins from the least to the greatest length, the last one closed; empty bins are left out."""
    edge = lengths.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    step = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double") / bins
    bin_ = F.least(F.floor((F.col("length") - F.col("lo")) / step), F.lit(bins - 1)).cast("long")
    return lengths.crossJoin(F.broadcast(edge)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def chunk_grid(pages: DataFrame, text: str, candidates: list[tuple[int, int]]) -> DataFrame:
    """Length statistics and page tallies for each candidate (size, overlap).  A page is cleaned once and chunked
    for all candidates in one Arrow function, which gives the lengths alone."""
    from ..functions.text import MIN_PAGE, chunk, cleaned

    @F.pandas_udf("array<array<int>>")
    def lengths_of(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[list[int]]:
            t = cleaned(t)
            return [[len(p) for p in chunk(t, *c)] if len(t) >= MIN_PAGE else [] for c in candidates]

        return s.map(one)

    # not deterministic to the optimiser, which else evaluates it again for every use
    grid = F.array(*(F.struct(F.lit(a).alias("size"), F.lit(b).alias("overlap")) for a, b in candidates))
    each = pages.select(lengths_of.asNondeterministic()(F.col(text)).alias("_l"))
    each = each.select(F.explode(F.arrays_zip(grid.alias("c"), F.col("_l").alias("l"))).alias("x")).select("x.c.size", "x.c.overlap", F.col("x.l").alias("l"))
    rows = each.select("size", "overlap", F.explode_outer("l").alias("length"), F.size("l").alias("pieces"))
    # a page of n pieces has n rows, so each stands for 1 / n of it; one without has a row of no length
    rows = rows.groupBy("size", "overlap", "pieces", F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.withColumn("c", F.when(F.col("length").isNotNull(), F.col("rows")).otherwise(0))
    pages_with = lambda c: F.round(F.sum(F.when(c, F.col("rows") / F.greatest("pieces", F.lit(1))).otherwise(0))).cast("long")
    over = F.round(100 * F.sum(F.when(F.col("length") > F.col("size"), F.col("c")).otherwise(0)) / F.sum("c"), 1)
    more = (over.alias("over_percent"), pages_with(F.col("pieces") > 1).alias("pages_split"), pages_with(F.col("pieces") == 1).alias("pages_single"), pages_with(F.col("pieces") == 0).alias("dropped"))
    return counted_quantiles(rows, ["size", "overlap"], more=more)
