from __future__ import annotations

from skein.llm.packing import pack_documents

from test_packing import DOCS


def test_only_containers_of_longer_tiers_have_gap_fillers(spark):
    docs = spark.createDataFrame([(i, "t", n, i, 0) for i, n in enumerate([20, 5, 5, 5, 5])], DOCS)
    packs = spark.createDataFrame([(1, 10), (2, 25)], "pack_id int, capacity_tokens int")
    rows = [r for r in pack_documents(docs, packs).collect() if r["pack_id"] == 2]
    long = next(r["container"] for r in rows if r["n_tokens"] == 20)
    assert {r["doc_id"]: r["fills_gap"] for r in rows} == {r["doc_id"]: r["container"] == long and r["n_tokens"] == 5 for r in rows}
    assert [r["fills_gap"] for r in rows].count(True) == 1
