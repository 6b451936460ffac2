import corpus_pipeline as p
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.decontaminate import normalised


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = docs, docs.columns
    items = [normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        after = stage(spark, before, sf)
        rows = {r.doc_id: r for r in before.collect()}
        if k == len(p.STAGES) - 1:
            tokens = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
            assert {r.doc_id for r in tokens} == rows.keys() and all(r.n == r.m for r in tokens)
            break
        assert after.columns == columns
        got = {r.doc_id: r for r in after.collect()}
        if name == "quality_rules":
            assert got.keys() == {d for d, r in rows.items() if quality.first_rejection(quality.Features(r.text), quality.RULES) is None}
        if name == "simhash_near_dedup":
            assert len({r.text for r in got.values()}) == len(got) and {r.text for r in rows.values()} - {r.text for r in got.values()} <= {r.text for d, r in rows.items() if d not in got}
        if name == "benchmark_decontamination":
            assert not any(b in normalised(r.text) for r in got.values() for b in items)
            assert all(d in got for d, r in rows.items() if not any(b[:25] in normalised(r.text) for b in items))
        if name == "secret_scans":
            assert got.keys() == rows.keys() and all(r.n_chars == len(r.text) for r in got.values())
            assert not any("token =" in r.text for r in got.values())
        before = spark.createDataFrame(list(got.values()), docs.schema)


def test_empty_corpus(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() == 0
