"""The pipeline where no language can be learned."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import langid

ROWS = [(1, "ein kurzer Text"), (2, "une phrase"), (3, "12345 67890"), (4, None), (5, ""), (6, "одно слово"), (7, "some words here")]


def table(spark, lang):
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("doc_id", "text", lang.alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


@pytest.mark.parametrize("lang", [lambda: F.lit(None).cast("string"), lambda: F.when(langid.held_out(F.col("doc_id")), "xx")])
def test_texts_with_letters_stay(spark, lang):
    docs = table(spark, lang())
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 2, 6, 7]


def test_pipeline_with_null_langs(spark, tmp_path, sf_dir):
    with_langs = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.withColumn("lang", F.lit(None).cast("string")).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == with_langs and got
