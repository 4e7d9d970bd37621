import json

import pytest

from tessella.operators import retrieval
from tessella.plans import pipelines


def test_ingest_and_search(spark, tmp_path):
    topics = {"deposit": "the deposit is returned at the end ", "repair": "repairs are the duty of the owner "}
    lines = [json.dumps({"page_content": t * 60, "metadata": {"source_type": "guide", "source_id": k, "doc_title": k, "pdf_page": 2}}) for k, t in topics.items()]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, "broken", json.dumps({"page_content": "tiny"})]))
    embedder = pipelines.hash_embedder()
    rejects = pipelines.ingest(spark, [str(tmp_path / "a.jsonl")], str(tmp_path / "t"), embedder, 32)
    assert rejects.count() == 1
    table = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.source_id, r.source_type) for r in table.collect()} == {("deposit", "guide"), ("repair", "guide")}
    assert table.where("chunk_index = 0").first().n_chunks > 1
    query = embedder(["who returns the deposit at the end"])[0]
    top = retrieval.dense_topk(table.withColumn("vec_id", table.chunk_index), query, k=1).first()
    assert top.source_id == "deposit"
    with pytest.raises(Exception, match="dimension"):
        pipelines.ingest(spark, [str(tmp_path / "a.jsonl")], str(tmp_path / "u"), embedder, 31)


def test_report(spark):
    rows = [(1, 0, 0, "임대인"), (1, 0, 1, "김가상"), (1, 0, 2, "보증금 1억\n근저당 설정\n전입신고"), (2, 0, 0, "은행"), (2, 0, 1, "x"), (2, 1, 0, "2024-01-01-2025"), (3, 0, 0, "빈 계약")]
    reports, rejected = pipelines.report(spark.createDataFrame(rows, "doc_id int, page int, region int, text string"))
    got = {r.doc_id: r for r in reports.collect()}
    assert set(got) == {1, 3} and [r.doc_id for r in rejected.collect()] == [2]
    assert (got[1].risk_level, got[1].score, got[1].label, got[1].redaction_counts) == ("HIGH", 71, "caution", {"name": 1})
    assert (got[3].risk_level, got[3].score) == ("LOW", 100) and len(got[3].redaction_scope) == 5
