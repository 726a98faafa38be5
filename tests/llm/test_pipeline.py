import corpus_pipeline as cp
from corvane.llm import rule_ledger as rl


def test_each_stage_keeps_the_columns_and_has_its_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "packing"]
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        out = cp._common.staged(stage(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "quality rules":
            kept = {r.doc_id for r in rl.op2(spark, sf_dir).filter("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "near-dedup":
            assert out.select("doc_id").distinct().count() == out.count() <= counts[-1]
        counts.append(out.count())
        docs = out
    pieces = cp.packing(spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert counts[0] > counts[1] == counts[2] >= counts[3]
