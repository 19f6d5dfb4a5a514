"""Vectors of texts that were embedded before, by the hash of the text: Parquet folders that are only ever added to, and
compaction.

An addition is a folder of its own that counts once it is complete. Two jobs that embed the same text at once both add it;
a text counts once when read, so nothing has to be locked, and what an addition repeats is harmless. When there are
more than ``FOLDERS`` additions they are merged into one, which is complete before the merged ones go; a reader meets either
or both. A merge costs one reading of the cache for every ``FOLDERS`` additions, and keeps the number of files small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.store import _delete, _exists, _names

FOLDERS = 16
VECTORS = "text_sha256 string, embedding array<float>"


def _whole(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, path, "part-") if _exists(spark, f"{path}/{n}/_SUCCESS")]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """text_sha256, embedding, one row for each text; no rows where nothing was added yet."""
    folders = [f"{path}/{n}" for n in _whole(spark, path)]
    if not folders:
        return spark.createDataFrame([], VECTORS)
    rows = spark.read.schema(VECTORS).parquet(*folders)
    return rows if len(folders) == 1 else rows.groupBy("text_sha256").agg(F.min("embedding").alias("embedding"))


def add_vectors(fresh: DataFrame, path: str) -> None:
    """Adds vectors (text_sha256, embedding, of unique text_sha256) to the cache, and merges it where that is due."""
    spark = fresh.sparkSession
    fresh.select("text_sha256", "embedding").write.parquet(f"{path}/part-{uuid.uuid4().hex}")
    if len(_whole(spark, path)) > FOLDERS:
        compact_vectors(spark, path)


def compact_vectors(spark: SparkSession, path: str) -> None:
    """Merges all additions into one, sorted within files by hash, so that files can be skipped by it."""
    merged = _whole(spark, path)
    rows = read_vectors(spark, path)
    rows.repartitionByRange("text_sha256").sortWithinPartitions("text_sha256").write.parquet(f"{path}/part-{uuid.uuid4().hex}")
    for n in merged:
        _delete(spark, f"{path}/{n}")
