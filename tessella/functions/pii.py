"""Personal data in pages of a contract: detection, masking, and the gate for what is left.

Matches need context (banking words anywhere in the text, labels before names, the region before) and
carry offsets, so they are found by one Arrow UDF; everything around it is DataFrame operations.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: The patterns of the kinds, words that must occur for accounts, labels before names, labels
#: that are no names, and what stands for each kind.
PATTERNS = {
    "resident_registration_number": r"(?<!\d)\d{6}\s*[-–—]?\s*[1-8]\d{6}(?!\d)",
    "phone_number": r"(?<!\d)(?:0\d{1,2})\s*[-.)]?\s*\d{3,4}\s*[-.]?\s*\d{4}(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "bank_account": r"\d{2,6}(?:\s*[-–—]\s*\d{2,6}){2,4}",
}
ACCOUNT_WORDS = ("계좌", "은행", "입금", "예금주")
NAME_LABELS = ("임대인", "임차인", "소유자", "성명", "이름", "예금주")
NOT_NAMES = ("주민번호", "연락처", "전화번호", "주소", "소재지", "계좌번호", "은행명")
PLACEHOLDERS = {
    "resident_registration_number": "[주민등록번호]",
    "phone_number": "[전화번호]",
    "email": "[이메일]",
    "bank_account": "[계좌번호]",
    "name": "[이름]",
}
EMAIL = PATTERNS["email"]
KINDS = tuple(PLACEHOLDERS)

_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
_ACCOUNT = re.compile("|".join(ACCOUNT_WORDS))
_NAME = re.compile(rf"(?:{'|'.join(NAME_LABELS)})\s*[:：]?\s*((?!{'|'.join(NOT_NAMES)})[가-힣]{{2,5}})")

MATCHES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))])


def find(text: str | None, before: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by place.  `before` is the region before this one: it gives context, and only
    matches that lie wholly in this text count."""
    text = text or ""
    shift = len(before) + 1 if before else 0
    whole = f"{before}\n{text}" if before else text
    out = []
    for kind, pattern in _COMPILED.items():
        if kind != "bank_account" or _ACCOUNT.search(whole):
            out += [(kind, *m.span()) for m in pattern.finditer(whole)]
    out += [("name", *m.span(1)) for m in _NAME.finditer(whole)]
    out.sort(key=lambda m: m[1:])
    return [(kind, a - shift, b - shift) for kind, a, b in out if a >= shift]


def mask(text: str | None, found: list[tuple[str, int, int]]) -> tuple[str, dict[str, int]]:
    """The text with a placeholder for each match, and how many of each kind; of overlapping matches the
    first counts."""
    text, at, out, counts = text or "", 0, [], {}
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            counts[kind] = counts.get(kind, 0) + 1
            at = b
    return "".join(out) + text[at:], counts


@F.pandas_udf(MATCHES)
def detect(text: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t, p)] for t, p in zip(text, before)])


@F.pandas_udf(MASKED)
def sanitize(text: pd.Series, before: pd.Series) -> pd.DataFrame:
    done = [mask(t, find(t, p)) for t, p in zip(text, before)]
    return pd.DataFrame({"text": [d[0] for d in done], "counts": [d[1] for d in done]})


def mask_emails(text: Column) -> Column:
    """Emails alone, in the JVM."""
    return F.regexp_replace(text, EMAIL, PLACEHOLDERS["email"].replace("[", r"\[").replace("]", r"\]"))


def mask_regions(regions: DataFrame) -> DataFrame:
    """regions (doc_id, page, region, text) with masked text and counts; a region sees the one before it on
    the same page."""
    before = F.lag("text").over(W.partitionBy("doc_id", "page").orderBy("region"))
    done = sanitize(F.col("text"), before)
    return regions.withColumn("_done", done).select("doc_id", "page", "region", F.col("_done.text").alias("text"), F.col("_done.counts").alias("counts"))


def _page_text(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("region", "text"))).alias("r")).select("doc_id", "page", F.array_join(F.col("r.text"), "\n").alias("text"))


def gate(masked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected) documents (doc_id, text) of masked regions: regions by line, pages by blank line; a
    document in which anything is still found as a whole is rejected."""
    docs = _page_text(masked).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    docs = docs.select("doc_id", F.array_join(F.col("p.text"), "\n\n").alias("text"))
    docs = docs.withColumn("_left", F.size(detect(F.col("text"), F.lit(None).cast("string"))))
    return docs.where("_left = 0").drop("_left"), docs.where("_left > 0").drop("_left")
