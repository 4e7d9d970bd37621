"""Rule-based reading of contracts: terms, risks, and what is missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import contract_type, field_after_label, lease_dates
from .text import strip

#: Severity, title, pattern, reason and recommendation of the risk rules, in order.
RISK_RULES = (
    (
        "HIGH",
        "권리 제한 또는 담보 설정 확인",
        r"근저당|담보권|압류|가압류|신탁",
        "계약서에 담보·압류·신탁 관련 문구가 있습니다. 실제 등기부등본과 일치하는지 확인해야 합니다.",
        "최신 등기부등본의 선순위 권리와 소유자가 다른 제출 서류와 일치하는지 확인하세요.",
    ),
    (
        "MEDIUM",
        "임차인 수선 책임 확인",
        r"임차인[^\n]{0,30}(?:수리|수선|원상복구)|모든[^\n]{0,20}(?:책임|비용)",
        "수선 또는 비용 부담이 임차인에게 넓게 부과될 가능성이 있습니다.",
        "구조·주요 설비의 수선 책임 범위를 임대인과 명확히 나누세요.",
    ),
    (
        "MEDIUM",
        "해지·위약금 조항 확인",
        r"위약금|계약금[^\n]{0,20}몰취|일방[^\n]{0,20}해지",
        "계약 해지 시 부담이 커질 수 있는 위약 조항이 포함돼 있습니다.",
        "해지 사유, 통지 기간과 위약금 산정 기준을 계약 전에 확인하세요.",
    ),
    (
        "LOW",
        "대항력 보호 조항",
        r"전입신고|확정일자|보증보험",
        "임차인의 대항력 또는 보증금 보호와 관련된 문구가 확인됩니다.",
        "입주 후 전입신고와 확정일자를 실제로 완료하고 보증보험 가능 여부를 확인하세요.",
    ),
)
#: Kinds of housing, the word that marks special terms, and what a contract must state.
PROPERTY_TYPES = ("아파트", "오피스텔", "연립주택", "다세대주택", "단독주택", "다가구주택")
SPECIAL = "특약"
REQUIRED = {"deposit": "보증금", "contract_start": "계약 시작일", "contract_end": "계약 종료일", "property_type": "주택 유형"}
CLAUSE = 240


def clause_of(text: Column, pattern: str, size: int = CLAUSE) -> Column:
    """The whole line or lines of the first match, stripped and cut; null without a match."""
    line = F.regexp_extract(text, rf"(?:^|\n)([^\n]*?(?:{pattern})[^\n]*)", 1)
    return F.when(text.rlike(pattern), F.nullif(F.substring(strip(line), 1, size), F.lit("")))


def risks(text: Column, rules=RISK_RULES) -> Column:
    """Array of (severity, title, clause, reason, recommendation) of the rules that match, in their order."""

    def issue(severity: str, title: str, pattern: str, reason: str, recommendation: str) -> Column:
        values = {"severity": F.lit(severity), "title": F.lit(title), "clause": clause_of(text, pattern), "reason": F.lit(reason), "recommendation": F.lit(recommendation)}
        return F.when(text.rlike(pattern), F.struct(*(v.alias(k) for k, v in values.items())))

    return F.filter(F.array(*(issue(*r) for r in rules)), lambda r: r.isNotNull())


def terms(text: Column) -> Column:
    """Struct of a contract's terms; fields that aren't found are null."""
    dates = lease_dates(text)
    rent = field_after_label(text, "월세", "차임")
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(x))
    special = F.slice(F.filter(lines, lambda x: x.contains(SPECIAL) & (F.length(x) > 2)), 1, 10)
    return F.struct(
        contract_type(rent).alias("contract_type"),
        field_after_label(text, "보증금", "임대차보증금").alias("deposit"),
        rent.alias("monthly_rent"),
        F.try_element_at(dates, F.lit(1)).alias("contract_start"),
        F.try_element_at(dates, F.lit(2)).alias("contract_end"),
        field_after_label(text, "소재지", "도로명주소", "주소").alias("address"),
        F.nullif(F.regexp_extract(text, f"({'|'.join(PROPERTY_TYPES)})", 1), F.lit("")).alias("property_type"),
        special.alias("special_terms"),
    )


def missing(found: Column) -> Column:
    """Names of the required terms that are null or empty."""
    return F.filter(F.array(*(F.when(F.coalesce(found[k], F.lit("")) == "", F.lit(v)) for k, v in REQUIRED.items())), lambda x: x.isNotNull())


def analyze(docs: DataFrame, analyser=None) -> DataFrame:
    """docs (doc_id, text) with terms, risks and missing_information.  With an analyser (text -> JSON text), its
    word comes first: analysis holds what it says, null where it fails, and the rules' columns stand beside it."""
    out = docs.withColumn("terms", terms(F.col("text"))).withColumn("risks", risks(F.col("text")))
    out = out.withColumn("missing_information", missing(F.col("terms")))
    if analyser is None:
        return out

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return analyser(t or "")
            except Exception:  # whatever a model's client raises, the rules stand in for it
                return None

        return s.map(one)

    return out.withColumn("analysis", ask(F.col("text")))
