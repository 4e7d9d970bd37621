"""Secret scans with multipart credential linking (DataFrame operations only).

Three patterns find secrets on their own.  A credential often comes in parts, though: an access
identifier, a secret and an endpoint, each too weak to report alone.  Weak parts are reported when a
part of another role lies within `scope` characters of them in the same document, from the end of one to the
start of the other.  That interval join runs on (document, bin): parts enter every bin of `scope` characters
that they cover and are summed up to the least start and greatest end per role and bin, so a weak part looks at
the bins within its reach and no pairs are made, however many parts a document has.

Spark has no function that gives the places of all matches; they follow from the lengths of the matches
and of the text between them (split by the same pattern).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, row_key

#: Fixed patterns of the three base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
VALUE = r"""^[^:=]*[:=]\x20*["']?(.*)$"""
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}

#: Weak parts: kind, role, a quick test, pattern.
WEAK = (
    ("weak_access", "access", r"A[KS]IA[A-Z0-9]{8}", r"\bA[KS]IA[A-Z0-9]{8,}"),
    ("weak_user", "access", r"(?i)access_?key|client_?id|username", r"""(?i:(?<!secret_)(?<!secret)access_?key(?:_?id)?|client_?id|username)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""),
    ("weak_assign", "secret", r"(?i)password|passwd|secret|token|api_?key", r"""(?i:password|passwd|secret(?:_?(?:access_?)?key)?|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    # 40 characters, or 32 and more of mixed case; "=" may stand before it, and pads it if no more follows
    ("weak_blob", "secret", r"[A-Za-z0-9+/]{32}", r"(?<![A-Za-z0-9+/])(?:(?=[a-z+/]*[A-Z0-9])(?=[^0-9]{0,39}[0-9])[A-Za-z0-9+/]{40}|(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}+={0,2}+)(?![A-Za-z0-9+/=])"),
    ("weak_endpoint", "endpoint", r"://|(?i)endpoint", r"""(?i:endpoint["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}|[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?)"""),
)
KINDS = ("assign", "access", "hex", *(w[0] for w in WEAK))
ROLE_OF_BASE = {"assign": "secret", "access": "access", "hex": "secret"}
SCOPE = 200

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_MATCHES = "array<struct<gap:int,len:int,value:int>>"
#: Matches whose places are summed up at a time: aggregate() copies what it holds at each step, so that one sum over
#: all matches of a text would be quadratic.
RUN = 64


def matches(text: Column, test: Column, pattern: str, value: str | None = None) -> Column:
    """Array of (gap, len, value) of the leftmost non-overlapping matches, in code points: the text between the match
    and the one before it, the match, and its value (the match, or group 1 of `value` in it)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    size = lambda m: F.length(F.regexp_extract(m, value, 1)) if value else F.length(m)
    each = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), size(m).alias("value")))
    return F.when(test, each).otherwise(F.array().cast(_MATCHES))


def spans(found: str, kind: int, min_value: int = 1) -> Column:
    """Array of (start, kind, end) from a column of matches; those whose value is shorter than min_value are dropped."""
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
    run = lambda r: F.slice(F.col(found), r * RUN + 1, F.lit(RUN))
    none = F.array().cast("array<int>")

    def begin(acc: Column, r: Column) -> Column:
        size = F.aggregate(run(r), F.lit(0), lambda n, m: n + m["gap"] + m["len"])
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["len"]).alias("end"))
        return F.struct((start + m["len"]).alias("at"), F.when(m["value"] >= min_value, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    begins = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("begins")), begin, lambda acc: acc["begins"])
    some = F.zip_with(begins, runs, lambda at, r: F.aggregate(run(r), F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")), step, lambda acc: acc["spans"]))
    return F.when(F.size(found) > 0, F.flatten(some)).otherwise(F.array().cast(_SPANS))


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base and linked
    (arrays of start, kind number in KINDS, end), base_sha256 and spans as text.

    A null text counts as empty and has no spans.  A weak part that overlaps a base span is the base
    span's; weak parts of kinds that overlap are told apart by kind and all reported.  Rows that repeat
    a doc_id and text get equal results.  Other columns of docs do not enter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = {
        "_assign": matches(text, text.rlike(WEAK[2][2]), ASSIGN, VALUE),
        "_access": matches(text, text.contains("AKIA"), ACCESS),
        "_hex": matches(text, text.rlike(r"[0-9a-f]{16}"), r"[0-9a-f]{16,}"),
    }
    found = base | {f"_{k}": matches(text, text.rlike(test), pattern) for k, _, test, pattern in WEAK}
    d = docs.select("doc_id", row_key(F.col("text")).alias("_row"), *(v.alias(k) for k, v in found.items()))
    d = materialize(d, "secrets-matches")  # places are read off columns, so no pattern is matched twice
    firm = [spans(f"_{k}", i, n) for i, (k, n) in enumerate(MIN_LENGTH.items())]
    weak = [spans(f"_{k}", i) for i, (k, *_) in enumerate(WEAK, 3)]
    d = d.select("doc_id", "_row", *(v.alias(f"_{k}") for k, v in zip(MIN_LENGTH, firm)), F.concat(*weak).alias("_weak"))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in MIN_LENGTH]
    d = d.select("doc_id", "_row", F.array_sort(F.concat(*(f"_{k}" for k in MIN_LENGTH))).alias("base"), "_weak", *counts)
    d = materialize(d, "secrets-parts")

    roles = F.array(*(F.lit(ROLE_OF_BASE.get(k) or WEAK[i - 3][1]) for i, k in enumerate(KINDS)))
    some = d.where(F.size("_weak") > 0).dropDuplicates(["doc_id", "_row"])
    parts = some.select("doc_id", "_row", F.explode(F.concat("base", "_weak")).alias("s"))
    bins = lambda first, last: F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope))).alias("bin")
    start, end = F.col("s.start"), F.col("s.end")
    # weak parts that overlap a base span are part of it; spans of a kind lie apart, so a bin holds few of them
    covered = parts.select("doc_id", "_row", "s", bins(start, end - 1))
    weak, firm = covered.where(F.col("s.kind") >= 3), covered.where(F.col("s.kind") < 3)
    firm = firm.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("bin").alias("_bin"), F.col("s.start").alias("_low"), F.col("s.end").alias("_high"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")) & (F.col("bin") == F.col("_bin"))
    within = weak.join(firm, same & (start < F.col("_high")) & (F.col("_low") < end), "left_semi")
    within = within.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("s").alias("_s")).distinct()
    parts = parts.join(within, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")) & (F.col("s") == F.col("_s")), "left_anti")
    parts = materialize(parts.withColumn("role", F.element_at(roles, F.col("s.kind") + 1)), "secrets-roles")
    reach = parts.select("doc_id", "_row", "role", "s", bins(start, end - 1)).groupBy("doc_id", "_row", "bin", "role").agg(F.min("s.start").alias("low"), F.max("s.end").alias("high"))
    reach = reach.withColumnsRenamed({"role": "other"})
    asks = parts.where(F.col("s.kind") >= 3).select("doc_id", "_row", "s", "role", bins(start - scope - 1, end + scope))
    same = asks["doc_id"].eqNullSafe(reach["doc_id"]) & (asks["_row"] == reach["_row"]) & (asks["bin"] == reach["bin"])
    # only the bins at the two ends of the reach hold parts beyond it, and each on one side
    near = (reach["low"] <= end + scope) & (reach["high"] >= start - scope)
    linked = asks.join(reach, same & (asks["role"] != reach["other"]) & near, "left_semi").select("doc_id", "_row", "s")
    linked = linked.distinct().groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(F.collect_list("s").alias("linked"))
    out = d.join(linked, d["doc_id"].eqNullSafe(linked["_d"]) & (d["_row"] == linked["_r"]), "left")
    out = out.withColumn("linked", F.coalesce(F.array_sort("linked"), F.array().cast(_SPANS)))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", "linked", F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.concat("base", "linked")).alias("spans")
    )


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's base spans and linked weak parts; see scan_secrets() for nulls, empties and repeats."""
    return scan_secrets(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
