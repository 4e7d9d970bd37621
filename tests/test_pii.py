from tessella.functions import pii


def kinds(t, before=None):
    return [k for k, _, _ in pii.find(t, before)]


def test_kinds():
    assert set(kinds("주민번호 900101-1234567 연락처 010-1234-5678 a.b@c.kr")) == {"resident_registration_number", "phone_number", "email"}
    assert kinds("기간 2024-01-01-2025") == []
    assert "bank_account" in kinds("은행 110-123-456789")
    assert kinds("임대인: 김가상 서울시 마포구 양화로 45") == ["name"]
    assert kinds("성명 연락처") == [] and kinds(None) == []


def test_label_in_the_region_before():
    assert pii.find("김가상", "임대인") == [("name", 0, 3)]
    assert pii.find("김가상") == []


def test_masking_leaves_nothing():
    t = "임대인 김가상 010-1234-5678 계좌 110-123-456789 x@y.kr"
    masked, counts = pii.mask(t, pii.find(t))
    assert pii.find(masked) == []
    assert counts["name"] == counts["email"] == 1 and sum(counts.values()) == 4


def test_gate_sees_the_whole_document(spark):
    rows = [(1, 0, 0, "2024-01-01-2025"), (1, 0, 1, "사이"), (1, 1, 0, "은행"), (2, 0, 0, "성명"), (2, 0, 1, "김가상"), (3, 0, 0, "a@b.kr 없음")]
    masked = pii.mask_regions(spark.createDataFrame(rows, "doc_id int, page int, region int, text string"))
    texts = {(r.doc_id, r.page, r.region): r.text for r in masked.collect()}
    assert texts[1, 0, 0] == "2024-01-01-2025" and texts[2, 0, 1] == "[이름]" and texts[3, 0, 0] == "[이메일] 없음"
    passed, rejected = pii.gate(masked)
    assert {r.doc_id for r in passed.collect()} == {2, 3} and {r.doc_id for r in rejected.collect()} == {1}
    assert {r.doc_id: r.text for r in passed.collect()}[2] == "성명\n[이름]"
