import corpus_pipeline

from aqlens.llm import exact, packing, quality, queries, simhash


def test_stages_in_order(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    names = docs.columns
    kept = {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, sf_small), "test-stage")
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept
        if k < 4:
            assert docs.columns == names and docs.schema == before.schema
        if name == "quality":
            net = quality.train(before, spark.read.parquet(f"{sf_small}/labels.parquet"))
            assert now == {r["doc_id"] for r in quality.score(before, net).filter("predicted = 1").collect()}
            assert sum(labels.get(i) == 1 for i in kept - now) <= 2
        if name == "exact_dedup":
            assert now == {r["doc_id"] for r in exact.exact_dedup(before).filter("kept").collect()}
        if name == "simhash":
            assert now == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
        if name in ("secrets", "packing"):
            assert now == kept
        if name == "secrets":
            assert queries.secrets.scan(docs).selectExpr("sum(size(base))").first()[0] == 0
            assert docs.filter("n_chars != length(text)").count() == 0
        kept = now
    assert len({r["sequence_id"] for r in docs.collect()}) <= -(-docs.groupBy().sum("length").first()[0] // packing.CAPACITY) + 1


def test_run_and_empty(spark, sf_small, no_docs):
    assert corpus_pipeline.run(spark, sf_small).count() > 0
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_small), "test-empty")
        assert docs.count() == 0, name
