"""Scalar rules of the document service as Columns: labels, levels, limits, times and retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Words by which a rent field says that there is none, and the two kinds of lease.
NO_RENT = r"없음|없다|해당\s*없|미해당|^무$|^[-–—/]+$|^0+\s*원?$"
LUMP_SUM, MONTHLY = "전세", "월세"
#: Limits of uploads.
MAX_FILES, MAX_MB, SUFFIXES = 10, 20, (".pdf", ".png", ".jpg", ".jpeg")
#: Similarity at which hits suffice, and below which the query is rewritten (once).
STRONG, WEAK, MAX_REWRITES = 0.45, 0.35, 1
#: Status codes after which a retry may help, attempts, base and cap of the wait in seconds.
RETRYABLE = (429, 500, 502, 503, 504)
MAX_ATTEMPTS, RETRY_BASE, RETRY_CAP = 3, 2, 30


def contract_type(rent: Column, known: Column | None = None) -> Column:
    """Kind of lease from the rent field; a kind that is known already stays."""
    text = strip(F.coalesce(rent, F.lit("")))
    found = F.when((text == "") | text.rlike(f"(?U){NO_RENT}"), F.lit(LUMP_SUM)).otherwise(F.lit(MONTHLY))
    return found if known is None else F.coalesce(F.nullif(known, F.lit("")), found)


def field_after_label(text: Column, *labels: str) -> Column:
    """Up to 40 characters of the line after the first of the labels, an optional colon between; null
    without one."""
    names = "|".join(f"\\Q{n}\\E" for n in labels)
    pattern = rf"(?U)(?:{names})\s*[:：]?\s*([^\n]{{1,40}})"
    value = F.regexp_extract(text, pattern, 1)
    return F.when(text.rlike(pattern), F.regexp_replace(value, "^[ ,]+|[ ,]+$", ""))


def lease_dates(text: Column) -> Column:
    """All dates of this century, year first, with dots, dashes, slashes or the words for year and month."""
    return F.regexp_extract_all(text, F.lit(r"(?U)20\d{2}\s*[.년/-]\s*\d{1,2}\s*[.월/-]\s*\d{1,2}\s*일?"), F.lit(0))


def address_candidates(raw: Column) -> Column:
    """An address and, if that differs, the address without floor, unit and block; none if it is blank."""
    base = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[()\[\]]", " ")
    base = F.regexp_replace(base, r"\*{2,}", " ")
    base = strip(F.regexp_replace(base, r"(?U)[\s\ufeff]+", " "))
    less = F.regexp_replace(base, r"(?U),?\s*제?\s*[0-9A-Za-z-]+\s*(?:층|호)(?![가-힣]).*$", "")
    # a block number goes once
    block = r"(?U)^(.*?),?\s*[0-9]+\s*동(?=\s|$)(.*)$"
    less = F.when(less.rlike(block), F.concat(F.regexp_extract(less, block, 1), F.regexp_extract(less, block, 2))).otherwise(less)
    less = strip(F.regexp_replace(less, r"(?U)[,\s]+$", ""))
    return F.filter(F.array_distinct(F.array(base, less)), lambda a: a != "")


def upload_verdict(n_files: Column, name: Column, size: Column) -> Column:
    """The first rule that an upload breaks: too_many, none, suffix, empty, too_large; else ok."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^.](\.[^./]+)$", 1))
    return (
        F.when(n_files > MAX_FILES, "too_many")
        .when(n_files == 0, "none")
        .when(~suffix.isin(*SUFFIXES), "suffix")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(size > MAX_MB * 1024 * 1024, "too_large")
        .otherwise("ok")
    )


def file_size_label(size: Column) -> Column:
    """Megabytes with a decimal (a tie goes to the even one, as in SQL's printf), whole kilobytes, or bytes."""
    return (
        F.when(size >= 1 << 20, F.concat(F.format_string("%.1f", F.bround(size / (1 << 20), 1)), F.lit("MB")))
        .when(size >= 1 << 10, F.concat(F.round(size / (1 << 10)).cast("long").cast("string"), F.lit("KB")))
        .otherwise(F.concat(size.cast("string"), F.lit("B")))
    )


def citation(kind: Column, title: Column, law: Column, article: Column, court: Column, number: Column) -> Column:
    """How a passage is cited: statutes and interpretations by law and article, precedents by court and
    number, cases by title and number, whatever lacks these and everything else by title."""
    title = F.coalesce(title, F.lit(""))
    both = lambda a, b: F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    return (
        F.when(kind.isin("statute", "interpretation"), F.coalesce(F.nullif(both(law, article), F.lit("")), title))
        .when(kind == "precedent", F.coalesce(F.nullif(both(court, number), F.lit("")), title))
        .when(kind.isin("mediation_case", "counsel_case"), F.trim(F.concat_ws(" ", title, F.nullif(number, F.lit("")))))
        .otherwise(title)
    )


def grade(top: Column, rewrites: Column) -> Column:
    """generate or rewrite, from the best similarity (null: 0) and the rewrites done."""
    top = F.coalesce(top, F.lit(0.0))
    return F.when(top >= STRONG, "generate").when((top < WEAK) & (rewrites < MAX_REWRITES), "rewrite").otherwise("generate")


def risk_level(ranks: Column) -> Column:
    """Level of the worst severity rank (3 high, 2 medium, 1 low); low if there is none."""
    return F.when(ranks == 3, "HIGH").when(ranks == 2, "MEDIUM").otherwise("LOW")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1).otherwise(0)


def safety_score(high: Column, medium: Column, low: Column) -> Column:
    """100 less 25, 12 and 4 for each item, 20 at least."""
    return F.greatest(F.lit(20), 100 - 25 * high - 12 * medium - 4 * low)


def safety_label(score: Column) -> Column:
    return F.when(score >= 80, "safe").when(score >= 60, "caution").otherwise("risk")


def calendar_bucket(day: Column, today: Column) -> Column:
    """today (the future too), yesterday, last_7_days, last_30_days, else the month as yyyy-mm."""
    days = F.datediff(today, day)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "last_7_days").when(days <= 30, "last_30_days").otherwise(F.date_format(day, "yyyy-MM"))


def relative_age(seconds: Column, then: Column) -> Column:
    """now, Nm, Nh or Nd by whole units since `then`, and from a week on its date."""
    n = lambda unit, letter: F.concat(F.floor(seconds / unit).cast("long").cast("string"), F.lit(letter))
    return F.when(seconds < 60, "now").when(seconds < 3600, n(60, "m")).when(seconds < 86400, n(3600, "h")).when(seconds < 7 * 86400, n(86400, "d")).otherwise(F.date_format(then, "yyyy.MM.dd"))


def progress(done: Column, total: Column) -> Column:
    """10 plus 60 by share, halves to even."""
    return (10 + F.bround(60.0 * done / total)).cast("int")


#: Progress at which a job's later stages stand.
STAGES = {"LLM": 80, "SAVING": 95, "COMPLETED": 100}


def stage_progress(stage: Column, done: Column, files: Column) -> Column:
    """Progress of a job by its stage: OCR goes with the files done, the later ones stand at fixed values."""
    out = F.when(stage == "OCR", progress(done, files))
    for name, value in STAGES.items():
        out = out.when(stage == name, value)
    return out.cast("int")


def retry_wait_cap(attempt: Column) -> Column:
    """Seconds before the jitter: doubling from the base, to the cap."""
    return F.least(RETRY_BASE * F.pow(F.lit(2.0), attempt - 1), F.lit(float(RETRY_CAP)))


def should_retry(code: Column, attempt: Column) -> Column:
    """Whether an attempt that failed with `code` (null: an unexpected error) is tried again."""
    return (code.isNull() | code.isin(*RETRYABLE)) & (attempt < MAX_ATTEMPTS)


def preview(text: Column, size: int = 80) -> Column:
    """The text, or its first `size` characters without space at their end and an ellipsis."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size), r"(?U)\s+$", ""), F.lit("…")))
