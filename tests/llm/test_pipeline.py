"""The pipeline's stages against plain versions of each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from tempora.plans.scratch import materialize
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = materialize(stage(spark, docs, sf_dir), name)
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "language":
            assert ids == sorted(d for d, t in rows if any(c.isalpha() for c in t or ""))
        if name == "near_dedup":
            assert ids == sorted({g for _, g in brute.near_dups(rows, 5, 80).values()})
        if name == "decontaminate":
            assert ids == sorted({d for d, _ in rows} - {d for d, _ in brute.leaks(rows, bench)})
        if name == "shard":
            assert ids == sorted(d for d, _ in rows)
            n = [r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()]
            assert len(n) == 40 and max(n) - min(n) <= 1
        else:
            assert out.columns == docs.columns
        docs = out


def test_odd_rows_pass_through(spark, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "some words of prose here and there", None, "s", 3), (2, "some words of prose here and there", None, "s", 3)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.withColumn("shard", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    assert {r.doc_id for r in docs.collect()} <= {2}
