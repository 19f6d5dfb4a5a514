"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it back as the next stage's documents. All stages but the last return the
columns of ``documents``. No stage takes doc_id for a key: rows are told apart by all that they hold, so ids may
repeat or be null. An empty table passes every stage; extra columns, whatever their names, stay as they are in
all stages but the last. ``run`` removes each stage's own scratch tables once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, langid, minhash, mixing, sentencepiece_aho
from leafmill.session import drop_scratch, materialize, scratch_mark, ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognised language go: those without letters, and those that every mixture of the learned
    languages explains worse than chance. Null and empty texts go with them; where no row has a language, all
    texts with letters stay; rows that repeat are judged alike."""
    ship_package(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identified(docs, model)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row of smallest doc_id stays (null last; of equal rows
    one). Null and empty texts are one such group; an id that repeats with other texts is judged by each."""
    ship_package(spark)
    return exact_dedup.deduplicated(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row stays, that of
    smallest doc_id (null last). Null and blank texts link with nothing and stay; very long texts count whole."""
    ship_package(spark)
    return minhash.representatives(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it, whether ids repeat or are null. Null and blank texts have
    no words, so the mix takes none of them; a null source is a source."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source, piece ids of every document, and whether they decode to its text. Null text gives
    null ids, an empty one an empty list; other columns of ``docs`` go."""
    ship_package(spark)
    return sentencepiece_aho.encode_report(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("near_dedup", one_of_near_duplicates),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded),
]

#: SQL cannot express the language and tokenizer stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = scratch_mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
