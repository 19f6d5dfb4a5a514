"""Random-projection buckets ahead of exact scoring, for stores too large to score whole.

A vector's bucket is the signs of its products with ``bits`` directions of components +1 and -1. A query looks into
the buckets whose signs differ from its own only where its products are small: the squares of the products whose
signs differ (of the vector at length one) add up to its ``reach`` at most. What it looks into is scored exactly,
by the grid of ``retrieval``, in which a bucket is a scope: buckets that hold very many rows, such as copies of one
vector, are cut into shards there and lose nothing.

``reach`` is fitted so that a share ``target`` of the nearest neighbours of sampled rows lies within it. The sample
has a bounded expected number of rows and of queries (parameters); neighbours among a sample are farther than
those among all rows, so the fit errs towards looking into more. Every row is in the index. Where vectors have no
neighbours to speak of, most buckets are looked into; where they come in clusters, few are.

Search stays exact by default (``retrieval``); this way has to be asked for. An empty table gives an index
without rows; vectors that are null or hold null, NaN or infinite components take no part; a zero vector looks into all
buckets, since all products with it are zero.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import retrieval
from leafmill.session import materialize

#: Buckets are folders, so there are 4096 of them at most; larger ones are sharded.
MOST_BITS = 12
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
TARGET = 0.99
_ROWS = "chunk_id string, embedding array<double>, bucket int"


class Settings(NamedTuple):
    bits: int
    reach: float


@lru_cache(maxsize=8)
def directions(bits: int, dim: int) -> np.ndarray:
    """Component j of direction i is +1 where the md5 of ``i:j`` begins with a hex digit under 8, else -1."""
    return np.array([[1.0 if hashlib.md5(f"{i}:{j}".encode()).hexdigest() < "8" else -1.0 for j in range(dim)] for i in range(bits)]).reshape(bits, dim)


def _products(bits: int):
    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        sizes = np.array([len(v) for v in vectors], np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            v = np.stack(vectors.iloc[at].to_numpy()).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            # -0.0 and 0.0 are one.
            found = np.round((v / np.where(norm > 0, norm, 1.0)) @ directions(bits, int(dim)).T, 9) + 0.0
            for row, p in zip(at, found, strict=True):
                out[row] = p
        return pd.Series(out, index=vectors.index)

    return run


def _usable(df: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))).where(F.col("embedding").isNotNull() & ~bad)


def bucketed(df: DataFrame, bits: int) -> DataFrame:
    """``df`` (with ``embedding``) with ``products`` and ``bucket``; unusable vectors go."""
    sides = F.transform("products", lambda x, i: F.when(x > 0, F.pow(F.lit(2), i).cast("int")).otherwise(0))
    return _usable(df).withColumn("products", _products(bits)("embedding")).withColumn("bucket", F.aggregate(sides, F.lit(0), lambda s, x: s + x))


def _cost(products: str, differ: Column) -> Column:
    weights = F.transform(products, lambda x, i: F.when(F.getbit(differ, i) == 1, x * x).otherwise(0.0))
    return F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)


def probes(queries: DataFrame, reach: float) -> DataFrame:
    """Bucketed ``queries`` with one row per bucket in reach, in ``bucket``. Buckets are found direction by
    direction, each time with those that are in reach so far, so no query goes through all of them."""
    step = (
        "aggregate(transform(products, (x, i) -> named_struct('mask', shiftleft(1, i), 'w', x * x)), array(named_struct('bucket', bucket, 'cost', 0D)), "
        "(s, x) -> concat(s, filter(transform(s, b -> named_struct('bucket', b.bucket ^ x.mask, 'cost', b.cost + x.w)), b -> b.cost <= {})))"
    ).format("double('Infinity')" if math.isinf(reach) else f"{reach!r}D")
    return queries.withColumn("bucket", F.explode(F.transform(F.expr(step), lambda b: b["bucket"])))


def _sampled(rows: DataFrame, n: int, size: int, salt: str) -> DataFrame:
    """About ``size`` of ``n`` rows, picked by a hash of chunk_id; all of them where there are no more."""
    if n <= size:
        return rows
    return rows.where(F.substring(F.sha2(F.concat(F.lit(salt), F.col("chunk_id")), 256), 1, 8) < f"{int(size / n * 16**8):08x}").dropDuplicates(["chunk_id"])


def fit_reach(rows: DataFrame, bits: int, n: int, k: int, target: float = TARGET, sample_rows: int = SAMPLE_ROWS, sample_queries: int = SAMPLE_QUERIES) -> float:
    """The reach within which a share ``target`` of the ``k`` nearest sampled rows of sampled queries lies. Infinite
    where no query has a neighbour."""
    known = materialize(bucketed(_sampled(rows.select("chunk_id", "embedding"), n, sample_rows, ""), bits), "sampled")
    asked = _sampled(rows.select("chunk_id", "embedding"), n, sample_queries, "q")
    asked = materialize(bucketed(asked.withColumn("query_id", F.col("chunk_id")), bits), "asked")
    near = retrieval.similarity(asked, known, k, skip="chunk_id").select("query_id", "chunk_id")
    pairs = near.join(known.select("chunk_id", F.col("bucket").alias("_at")), "chunk_id").join(asked.select("query_id", "products", "bucket"), "query_id")
    cost = pairs.select(_cost("products", F.col("bucket").bitwiseXOR(F.col("_at"))).alias("cost"))
    reach = cost.agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY cost)")).first()[0]
    return math.inf if reach is None else round(reach, 9) + 1e-9


def write_index(
    chunks: DataFrame, path: str, k: int = 8, target: float = TARGET, bits: int | None = None, sample_rows: int = SAMPLE_ROWS, sample_queries: int = SAMPLE_QUERIES
) -> Settings:
    """An index of the vectors of ``chunks`` (chunk_id, embedding) in the new folder ``path``: rows by bucket, and the
    settings, which are written last, so that an index that was cut short is none. Where ``bits`` is None, there are about
    a square root of the rows over 8 buckets, since a query is copied to each bucket in its reach. Rows are dealt by ranges of bucket
    and hash, so a bucket of any size is written by as many tasks as it needs."""
    spark = chunks.sparkSession
    usable = _usable(chunks.where("chunk_id IS NOT NULL"))
    n = usable.count()
    bits = bits or max(1, min(MOST_BITS, math.ceil(math.log2(math.sqrt(n) / 8)) if n else 1))
    rows = bucketed(usable.select("chunk_id", "embedding"), bits).drop("products")
    rows.repartitionByRange("bucket", F.xxhash64("chunk_id")).write.partitionBy("bucket").parquet(f"{path}/rows")
    reach = fit_reach(spark.read.schema(_ROWS).parquet(f"{path}/rows"), bits, n, k, target, sample_rows, sample_queries)
    spark.createDataFrame([(bits, reach)], "bits int, reach double").coalesce(1).write.parquet(f"{path}/settings")
    return Settings(bits, reach)


def read_settings(spark: SparkSession, path: str) -> Settings:
    return Settings(*spark.read.schema("bits int, reach double").parquet(f"{path}/settings").first())


def read_rows(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The index's rows; with ``buckets`` only their folders are opened."""
    rows = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def search_index(queries: DataFrame, path: str, k: int = 8, skip: str | None = None) -> DataFrame:
    """query_id, rank, score (four places), chunk_id: the ``k`` best of the rows in each query's reach, ties by
    chunk_id. ``skip`` as in ``retrieval.similarity``. Buckets that no query reaches are not read; which these are is
    known to the driver as a list of 4096 numbers at most."""
    spark = queries.sparkSession
    settings = read_settings(spark, path)
    asked = materialize(probes(bucketed(queries, settings.bits), settings.reach), "probes")
    reached = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    left_out = (F.col(skip) if skip else F.lit(None)).cast("string").alias("skip")
    scope, dim = F.col("bucket").cast("string").alias("scope"), F.size("embedding").alias("dim")
    q = asked.select("query_id", scope, left_out, F.col("embedding").alias("v"), dim)
    c = read_rows(spark, path, reached).select("chunk_id", scope, F.col("embedding").alias("v"), dim)
    found = retrieval.met(q, c, k, queries.schema["query_id"].dataType.simpleString())
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.round("sim", 4).alias("score"), "chunk_id")


def search_report(queries: DataFrame, chunks: DataFrame, path: str, k: int = 8, skip: str | None = None) -> DataFrame:
    """For each query what the index finds of the exact ``k`` nearest, and at what price: query_id, n_exact, n_found,
    n_examined (rows in reach)."""
    settings = read_settings(queries.sparkSession, path)
    exact = retrieval.retrieve_top_k(queries, chunks.select("chunk_id", "embedding"), k, skip=skip).select("query_id", "chunk_id")
    found = search_index(queries, path, k, skip).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    sizes = read_rows(queries.sparkSession, path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    seen = probes(bucketed(queries.select("query_id", "embedding"), settings.bits), settings.reach).select("query_id", "bucket")
    seen = seen.join(sizes, "bucket").groupBy("query_id").agg(F.sum("n").alias("n_examined"))
    return hits.join(seen, "query_id", "left").withColumn("n_examined", F.coalesce("n_examined", F.lit(0).cast("long")))
