import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import rules, scalars


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(*columns).first()


def test_contract_kinds(spark):
    rents = [None, "", "   ", "없음", "해당 없음", "무", "-", "0원", "금 오십만원정", "70만원", "700,000원"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rents)], "i int, r string")
    got = [r[1] for r in df.select("i", scalars.contract_type(F.col("r"))).orderBy("i").collect()]
    assert got == ["전세"] * 8 + ["월세"] * 3


CONTRACT = "보증금: 금 일억원\n월세 : 50만원, \n소재지 서울시 마포구 1\n기간 2024.01.02~2026년 1월 1일\n오피스텔 근저당 설정\n특약 1. 전입신고 협조\n임차인은 파손 시 수리\n"


def test_analysis(spark):
    r = rules.analyze(spark.createDataFrame([(1, CONTRACT), (2, "아무것도 없음")], "doc_id int, text string")).orderBy("doc_id").collect()
    t = r[0].terms
    assert (t.contract_type, t.deposit, t.monthly_rent, t.address, t.property_type) == ("월세", "금 일억원", "50만원", "서울시 마포구 1", "오피스텔")
    assert (t.contract_start, t.contract_end) == ("2024.01.02", "2026년 1월 1일")
    assert t.special_terms == ["특약 1. 전입신고 협조"]
    assert [(x.severity, x.clause) for x in r[0].risks] == [("HIGH", "오피스텔 근저당 설정"), ("MEDIUM", "임차인은 파손 시 수리"), ("LOW", "특약 1. 전입신고 협조")]
    assert r[0].missing_information == []
    assert r[1].risks == [] and len(r[1].missing_information) == 4 and r[1].terms.contract_type == "전세"


def test_addresses(spark):
    cases = {
        "서울특별시 강남구 테헤란로 123, 제3층 제301호": ["서울특별시 강남구 테헤란로 123, 제3층 제301호", "서울특별시 강남구 테헤란로 123"],
        "서울특별시 송파구 올림픽로 300 101동 1503호": ["서울특별시 송파구 올림픽로 300 101동 1503호", "서울특별시 송파구 올림픽로 300"],
        "서울특별시 강남구 역삼동 123-4": ["서울특별시 강남구 역삼동 123-4"],
        "경기도 성남시 분당구 판교역로 235": ["경기도 성남시 분당구 판교역로 235"],
        "  서울시   마포구 (양화로)  45  *** ": ["서울시 마포구 양화로 45"],
        "   ": [],
    }
    for raw, want in cases.items():
        assert one(spark, scalars.address_candidates(F.col("r")), r=raw)[0] == want


@pytest.mark.parametrize("h, m, n, score, label", [(0, 0, 0, 100, "safe"), (1, 0, 0, 75, "caution"), (1, 2, 0, 51, "risk"), (0, 0, 5, 80, "safe"), (4, 1, 1, 20, "risk")])
def test_score(spark, h, m, n, score, label):
    s = scalars.safety_score(F.col("h"), F.col("m"), F.col("n"))
    assert tuple(one(spark, s, scalars.safety_label(s), h=h, m=m, n=n)) == (score, label)


def test_numbers(spark):
    got = [one(spark, scalars.progress(F.col("i"), F.col("n")), n=n, i=i)[0] for n, i in [(3, 1), (3, 2), (3, 3), (8, 1), (8, 3), (40, 1), (24, 1)]]
    assert got == [30, 50, 70, 18, 32, 12, 12]
    assert [one(spark, scalars.retry_wait_cap(F.col("a")), a=a)[0] for a in range(1, 7)] == [2, 4, 8, 16, 30, 30]
    routes = [(0.45, 0), (0.44, 0), (0.35, 0), (0.34, 0), (0.34, 1)]
    assert [one(spark, scalars.grade(F.col("s"), F.col("a")), s=s, a=a)[0] for s, a in routes] == ["generate"] * 3 + ["rewrite", "generate"]
    assert one(spark, scalars.grade(F.lit(None).cast("double"), F.lit(0)), x=1)[0] == "rewrite"
    labels = [one(spark, scalars.file_size_label(F.col("s")), s=s)[0] for s in (512, 1536, 3 << 20)]
    assert labels == ["512B", "2KB", "3.0MB"]


def test_calendar(spark):
    days = {"2026-07-25": "today", "2026-07-26": "today", "2026-07-24": "yesterday", "2026-07-18": "last_7_days", "2026-07-17": "last_30_days", "2026-06-25": "last_30_days", "2026-06-24": "2026-06"}
    for day, want in days.items():
        d = datetime.date.fromisoformat(day)
        assert one(spark, scalars.calendar_bucket(F.col("d"), F.lit(datetime.date(2026, 7, 25))), d=d)[0] == want
