"""Exact vector retrieval for many queries at once.

Queries and chunks meet block by block in a grid: query blocks and chunk shards have a bounded number of
rows, and each cell is a matrix product whose k best per query go on. A grouped rank merges the shards, so
that the shuffle carries (queries x shards x k) rows and neither table is ever whole in one task. A scope (a
document, a source) is part of the cells' key, so chunks that no query of their scope asks for are not scored; a
scope has as many blocks and shards as its own rows need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import broadcast_if_small, materialize

BLOCK, SHARD = 1024, 16384
#: Queries of a block that are scored at once.
ROWS = 64
CANDIDATES = 30
MODES = ("top_k", "threshold", "mmr")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _cell(k: int):
    """Arrow tables of a cell; scores are made for ``ROWS`` queries at a time, so that a cell takes little more than its chunks."""

    def run(key: tuple, queries: pa.Table, chunks: pa.Table) -> pa.Table:
        who, what, sims = [], [], []
        ids = chunks.column("chunk_id")
        if queries.num_rows and chunks.num_rows:
            chunks = chunks.select(["chunk_id", "v"]).sort_by("chunk_id")
            ids, c, q = chunks.column("chunk_id"), _matrix(chunks.column("v")), _matrix(queries.column("v"))
            named = ids.combine_chunks().dictionary_encode()
            codes = named.indices.to_numpy()  # ascending, as the ids are
            skips = pc.index_in(queries.column("skip"), value_set=named.dictionary).to_pylist()
            for at in range(0, len(q), ROWS):
                for n, row in enumerate(q[at : at + ROWS] @ c.T, at):
                    if skips[n] is not None:
                        row[slice(*np.searchsorted(codes, [skips[n], skips[n] + 1]))] = -np.inf
                    found = np.arange(len(row))
                    if len(row) > k:
                        # Everything that ties with the k-th best stays; the merge breaks ties by id.
                        floor = np.partition(row, len(row) - k)[len(row) - k]
                        found = np.flatnonzero(row >= floor - 1e-12)
                    found = found[row[found] > -np.inf]
                    best = found[np.lexsort((found, -np.round(row[found], 12)))[:k]]
                    who.append(np.full(len(best), n))
                    what.append(best)
                    sims.append(row[best])
        flat = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        columns = [queries.column("query_id").take(flat(who, np.int64)), ids.take(flat(what, np.int64)), pa.array(flat(sims, np.float64))]
        return pa.table(columns, names=["query_id", "chunk_id", "sim"])

    return run


def met(q: DataFrame, c: DataFrame, k: int, kind: str) -> DataFrame:
    """The k best chunks of each query of each shard of its scope."""
    scopes = c.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards")).join(q.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "scope")
    scopes = broadcast_if_small(materialize(scopes, "scopes"))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pick = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    q = q.join(scopes, "scope").withColumn("block", pick("query_id", "blocks")).withColumn("shard", number("shards"))
    c = c.join(scopes, "scope").withColumn("shard", pick("chunk_id", "shards")).withColumn("block", number("blocks"))
    keys = ("scope", "block", "shard", "dim")
    return q.drop("shards", "blocks").groupBy(*keys).cogroup(c.drop("shards", "blocks").groupBy(*keys)).applyInArrow(_cell(k), f"query_id {kind}, chunk_id string, sim double")


def similarity(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, scope: str | None = None, skip: str | None = None) -> DataFrame:
    """The ``k`` nearest chunks of each query: query_id, chunk_id, sim (inner product of unit vectors), pos
    (from 1; ties by chunk_id). With ``scope`` a query whose column of that name is not null sees only
    chunks with an equal one. ``skip`` names a column of the queries with a chunk_id that a query leaves out (its own).
    Rows with a null vector take no part."""
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    own = (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope")
    left_out = (F.col(skip) if skip else F.lit(None)).cast("string").alias("skip")
    q = queries.where("embedding IS NOT NULL").select("query_id", own, left_out, vector, F.size("embedding").alias("dim"))
    c = chunks.where("embedding IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", own, vector, F.size("embedding").alias("dim"))
    kind = queries.schema["query_id"].dataType.simpleString()
    all_ = F.lit("")
    found = met(q.where("scope IS NULL").withColumn("scope", all_), c.withColumn("scope", all_), k, kind)
    if scope:
        found = found.unionByName(met(q.where("scope IS NOT NULL"), c.where("scope IS NOT NULL"), k, kind))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), "chunk_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def _with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    keep = [c for c in ("text", "source", "doc_id", "page_start", "page_end") if c in chunks.columns]
    return hits.join(chunks.select("chunk_id", *keep), "chunk_id", "left")


def filter_source(chunks: DataFrame, source: str | None = None, doc_ids: DataFrame | None = None) -> DataFrame:
    """Chunks of one source, or of the documents in ``doc_ids`` (doc_id); both None keep all."""
    if source is not None:
        chunks = chunks.where(F.col("source") == source)
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi") if doc_ids is not None else chunks


def retrieve_top_k(queries: DataFrame, chunks: DataFrame, k: int | None = 8, scope: str | None = None, skip: str | None = None) -> DataFrame:
    """query_id, rank, score (four places), chunk_id and the chunk's columns; k of 0 or None is 8."""
    hits = similarity(queries, chunks, k or 8, scope, skip)
    return _with_text(hits.select("query_id", F.col("pos").alias("rank"), F.round("sim", 4).alias("score"), "chunk_id"), chunks)


def retrieve_threshold(
    queries: DataFrame, chunks: DataFrame, k: int | None = 8, threshold: float = 0.5, candidate_cap: int = CANDIDATES, scope: str | None = None, skip: str | None = None
) -> DataFrame:
    """Of the ``candidate_cap`` nearest, those whose rounded score reaches the threshold, k at most."""
    near = similarity(queries, chunks, candidate_cap, scope, skip).withColumn("score", F.round("sim", 4)).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return _with_text(near.withColumn("rank", rank).where(F.col("rank") <= (k or 8)).select("query_id", "rank", "score", "chunk_id"), chunks)


def _diverse(k: int, weight: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v, rel = np.stack(pdf["v"].to_numpy()), pdf["sim"].to_numpy()
        near, left, picked = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(picked) < k:
            value = [round(weight * rel[i] - (1 - weight) * near[i], 12) for i in left]
            best = left.pop(int(np.argmax(value)))
            own = v @ v[best]
            near = own if not picked else np.maximum(near, own)
            picked.append(best)
        got = pdf.iloc[picked]
        return pd.DataFrame({"query_id": got["query_id"], "rank": np.arange(1, len(got) + 1), "score": got["sim"], "chunk_id": got["chunk_id"]})

    return run


def retrieve_mmr(
    queries: DataFrame, chunks: DataFrame, k: int | None = 8, weight: float = 0.7, threshold: float = 0.5, candidate_cap: int = CANDIDATES, scope: str | None = None,
    skip: str | None = None,
) -> DataFrame:
    """Maximal marginal relevance among the candidates at or over the threshold (unrounded): at most
    ``candidate_cap`` rows a query meet in a group. The score is the relevance."""
    near = similarity(queries, chunks, candidate_cap, scope, skip).where(F.col("sim") >= threshold)
    vectors = chunks.select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    kind = queries.schema["query_id"].dataType.simpleString()
    picked = near.join(vectors, "chunk_id").groupBy("query_id").applyInPandas(_diverse(k or 8, weight), f"query_id {kind}, rank int, score double, chunk_id string")
    return _with_text(picked, chunks)


def retrieve(queries: DataFrame, chunks: DataFrame, mode: str = "mmr", **settings) -> DataFrame:
    found = {"top_k": retrieve_top_k, "threshold": retrieve_threshold, "mmr": retrieve_mmr}.get(mode.lower())
    if found is None:
        raise ValueError(f"unknown mode {mode!r}; valid modes: {', '.join(MODES)}")
    return found(queries, chunks, **settings)


def raw_top3(queries: DataFrame, chunks: DataFrame, skip: str | None = None) -> DataFrame:
    """The three best raw scores of each query, before any filter."""
    return similarity(queries, chunks, 3, skip=skip).select("query_id", F.col("pos").alias("rank"), F.round("sim", 4).alias("score"), "chunk_id")


def no_context(queries: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries without a hit."""
    return queries.join(hits.select(key).distinct(), key, "left_anti")


def threshold_sweep(hits: DataFrame, grid: list[float]) -> DataFrame:
    """For each threshold how many queries keep a hit: threshold, accepted, rejected. One aggregate over the
    best score of each query, one column per threshold."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    counts = best.agg(*[F.count_if(F.col("best") >= t).alias(f"t{n}") for n, t in enumerate(grid)], F.count(F.lit(1)).alias("n"))
    rows: list[Column] = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{n}").alias("accepted"), (F.col("n") - F.col(f"t{n}")).alias("rejected")) for n, t in enumerate(grid)]
    return counts.select(F.inline(F.array(*rows)))
