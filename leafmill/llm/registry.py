"""The query of each operator over its whole intended table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    chat_format, conversation_repair, exact_dedup, external_shuffle, langid, license_scan, maxscore, minhash, mixing, periodic_runs, pii, secret_scan, sentencepiece_aho,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_turns(_table(spark, sf_dir, "conversations"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_rows(_table(spark, sf_dir, "conversations"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_aho.encode_report(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_report(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle.shard_report(_table(spark, sf_dir, "documents"), 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_secret_scan": op1_secret_scan, "op2_pii": op2_pii, "op3_exact_dedup": op3_exact_dedup, "op4_chat_format": op4_chat_format, "op4_preference_pairs": op4_preference_pairs, "op5_near_duplicates": op5_near_duplicates, "op6_mixing": op6_mixing, "op7_sentencepiece": op7_sentencepiece, "op8_license_scan": op8_license_scan, "op9_language_id": op9_language_id, "op10_maxscore": op10_maxscore, "op11_conversation_repair": op11_conversation_repair, "op12_external_shuffle": op12_external_shuffle, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.oracle(), "op3_exact_dedup": exact_dedup.ORACLE, "op4_chat_format": chat_format.ORACLE, "op4_preference_pairs": chat_format.PAIRS_ORACLE, "op5_near_duplicates": minhash.ORACLE, "op6_mixing": mixing.ORACLE, "op10_maxscore": maxscore.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE}
