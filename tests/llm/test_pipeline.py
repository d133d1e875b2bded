import corpus_pipeline
from larkspan.llm import decontaminate, quality, simhash


def test_stages_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, d).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append(ids)
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert ids == {r.doc_id for r in quality.op4_quality_rules(spark, d).collect() if r.kept}
        if i == 1:
            assert ids == {r.doc_id for r in simhash.keep_one(before).collect()} and ids <= {r.component_id for r in simhash.near_duplicates(before).collect()}
        if i == 2:
            assert ids == {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{d}/benchmark.parquet")).filter("NOT contaminated").collect()}
    assert all(a > b for a, b in zip(seen[:3], seen[1:4], strict=True)) and seen[3] == seen[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == seen[4]
