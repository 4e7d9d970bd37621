"""Line dedup by distinct-site spread (DataFrame operations only).

A line that stands on many sites is boilerplate.  Its spread is the number of distinct sites among its
occurrences, estimated by HyperLogLog sketches per line hash that aggregation merges; only lines whose
estimate lies near the threshold get an exact distinct count, so the decision is the exact one.

Lines that occur fewer times than the threshold cannot reach it; a plain count (summed before the
shuffle) sets them aside before any sketch is built.  What is written between steps is the occurrences
of repeated lines, never the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, own_name, read, row_key

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's buckets; its relative standard error is about 1.04 / sqrt(2**LG_K).
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
NEAR = 5.0


def _lines(docs: DataFrame) -> DataFrame:
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    cells = docs.select("doc_id", row_key(F.col("text")).alias("_row"), site.alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    return cells.where(line != "").select("doc_id", "_row", "site", "pos", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def boilerplate_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> tuple[DataFrame, DataFrame]:
    """(lines, occurrences): the hashes of boilerplate lines with the place of their first occurrence (by
    doc_id, then line number; null if no row with an id has the line), and the occurrences of all lines
    that occur min_sites times."""
    lines = _lines(docs)
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    often = materialize(often.select("h1", "h2"), "lines-often")
    seen = materialize(lines.join(bounded(often), ["h1", "h2"]), "lines-seen")
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))
    spread = seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("_sketch"), F.min(place).alias("first"))
    spread = materialize(spread.select("h1", "h2", "first", F.hll_sketch_estimate("_sketch").alias("estimate")), "lines-spread")
    error = NEAR * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error), min_sites * (1 + error) + 1
    sure = spread.where(F.col("estimate") >= high).select("h1", "h2", "first")
    near = spread.where((F.col("estimate") >= low) & (F.col("estimate") < high))
    sites = seen.join(bounded(near.select("h1", "h2")), ["h1", "h2"]).select("h1", "h2", "site").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    found = sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))
    return materialize(found, "lines-found"), seen


def dedup_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_boilerplate (lines that are
    boilerplate and not its first occurrence), n_removed and whole_copy.

    A line counts by its text without surrounding spaces; blank lines are kept and never counted.  The
    first occurrence of each boilerplate line in the corpus stays, where rows with a null doc_id hold none.
    Boilerplate goes whatever its share of a text.  Only a text of which no line but blank ones would be
    left is no page with boilerplate but a copy of a page, of which whole-document deduplication has to
    leave one: it stays as it is, with whole_copy true and n_removed 0.

    A null text stays null with no lines, an empty one has one blank line; a null source is one site; rows
    that repeat a doc_id and text are treated alike.  Other columns are passed on, whatever their names; if
    one has the name of a figure, the figure's gets an underscore after it.
    """
    found, seen = boilerplate_lines(docs, min_sites=min_sites, lg_k=lg_k)
    at = seen.join(bounded(found), ["h1", "h2"])
    first = F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")), F.lit(False))
    drop = at.where(~first).groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_key")).agg(F.collect_set("pos").alias("_drop"))
    # a row of the caller travels as one value, its text as lines
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(F.struct(*rest).alias("_rest"), F.split("text", "\n").alias("_lines"), row_key(F.col("text")).alias("_row_key"))
    d = d.join(drop, F.col("_rest.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row_key") == F.col("_key")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    d = d.withColumn("_kept", F.when(F.col("_drop").isNotNull(), F.transform(stay, lambda i: F.get(F.col("_lines"), i))))
    copy = F.col("_drop").isNotNull() & ~F.exists("_kept", lambda x: F.trim(x) != "")
    cut = F.col("_drop").isNotNull() & ~copy
    text = F.when(cut, F.array_join("_kept", "\n")).otherwise(F.array_join("_lines", "\n"))
    flagged = F.coalesce(F.when(F.col("_drop").isNotNull(), F.size("_drop")), F.lit(0)).cast("long")
    out = {c: text if c == "text" else F.col("_rest")[c] for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    figures = {
        "n_lines": F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long"),
        "n_boilerplate": flagged,
        "n_removed": F.when(cut, flagged).otherwise(F.lit(0)).cast("long"),
        "whole_copy": copy,
    }
    for name, value in figures.items():
        out[own_name(name, docs.columns)] = value
    return d.select(*(v.alias(c) for c, v in out.items()))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document after line dedup over its sources; see dedup_lines() for nulls, blanks and repeats."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "source", "n_lines", "n_boilerplate", "n_removed", "whole_copy", "text")


ORACLE = f"""
WITH cells AS (
  SELECT doc_id, text, coalesce('s' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), spread AS (
  SELECT trim(line) AS line, min((doc_id, pos)) FILTER (doc_id IS NOT NULL) AS f FROM cells WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}
), flagged AS (
  SELECT c.doc_id, c.text, c.pos FROM cells c JOIN spread s ON trim(c.line) = s.line WHERE c.doc_id IS NULL OR s.f IS NULL OR (c.doc_id, c.pos) <> s.f GROUP BY ALL
), dropped AS (
  SELECT doc_id, text, list(pos) AS p FROM flagged GROUP BY ALL
), cut AS (
  SELECT d.doc_id, d.source, d.text, p, CASE WHEN p IS NOT NULL THEN list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(p, i - 1)) END AS kept
  FROM documents d LEFT JOIN dropped x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text
), told AS (
  SELECT *, p IS NOT NULL AND len(list_filter(kept, lambda x: trim(x) <> '')) = 0 AS whole_copy FROM cut
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(p), 0)::BIGINT AS n_boilerplate,
  CASE WHEN p IS NOT NULL AND NOT whole_copy THEN len(p) ELSE 0 END::BIGINT AS n_removed, whole_copy,
  CASE WHEN p IS NOT NULL AND NOT whole_copy THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM told
"""
