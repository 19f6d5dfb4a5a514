"""Exact top-k by integer inner product with MaxScore.

A query's terms are its dimensions, a term's weight is the query's component, and a posting (row, value) says that a
vector's component is not zero. A shard keeps one postings list a term, by row, with the greatest and the
least value of each stretch of ``STRETCH`` rows. For a query these give every term a score bound in a
stretch: the most that it can add, zero at least, since a row may be missing from the list.

A query works through the stretches of a shard with the k-th best score so far as its threshold. Terms are put in the
order of their bounds; the longest run of the smallest ones whose bounds together stay under the threshold is
non-essential: a row that occurs in none of the other lists cannot reach it. Only the postings of the
essential terms are traversed. A row stays competitive while its partial score and the bounds of the terms not
yet looked at reach the threshold; for such rows the other lists are probed by binary search, greatest bound
first, a few at a time. The threshold rises from stretch to stretch. A shard returns its k best for each query; a grouped rank over
these merges the shards.

Scale: shards and query blocks hold a bounded number of vectors. They meet in the cells of a grid (query block x
shard), one task input each, so neither the queries nor the vectors are ever in one task or broadcast; the work
is that of a stated query set against all rows, in blocks. A cell reads BLOCK + SHARD vectors for BLOCK * SHARD
scores, so each vector's copy is paid for by a thousand or more scores of its own, at any size.

Rows that are equal in vec_id and vector are counted before they are dealt, and a shard has one row for them, so that
no number of repeats makes a shard large; each of them has its place among the results again.

Scores are whole: where the products of a cell could pass 2**53, up to which doubles hold every whole number, the lists hold Python's
integers instead, which are slower and exact. A score beyond the range of a long is given as the range's end, and ties there.

Edge cases: vectors that are null, empty, or hold null or non-finite components (or such as are not finite when scaled) take no part; vectors
whose length differs from the query's are no candidates for it; ties go to the smaller vec_id; rows
with null vec_id take no part; rows that repeat a vec_id other than the query's are candidates each, and rows
that repeat a query's vec_id are queries whose hits share one list of ranks; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 2048
STRETCH = 2048
#: Lists that are probed before rows that have fallen behind are left out.
PROBE = 6

SCHEMA = "query_id long, vec_id long, score long, times long"

#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
LONG = 2**63


class Postings:
    """The inverted lists of a shard (rows x terms, whole numbers), stretch by stretch. A list that holds most rows
    of a stretch is kept as one value a row, zeros included; the others as ascending rows and their values."""

    def __init__(self, x: np.ndarray):
        self.stretches: list[tuple] = []
        for at in range(0, len(x), STRETCH):
            own = x[at : at + STRETCH]
            whole = np.flatnonzero((own != 0).sum(axis=0) * 2 > len(own))
            place = np.full(x.shape[1], -1)
            place[whole] = np.arange(len(whole))
            sparse = {t: (r, own[r, t]) for t in np.flatnonzero(place < 0) if len(r := np.flatnonzero(own[:, t]))}
            self.stretches.append((at, len(own), np.ascontiguousarray(own[:, whole].T), place, sparse, own.min(axis=0), own.max(axis=0)))

    def top(self, query: np.ndarray, k: int, skip: np.ndarray | None = None, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the k best rows but those in ``skip``, and all that tie with the last of them.
        ``seen`` is given the number of postings traversed in each stretch."""
        scores, rows = np.zeros(0, query.dtype), np.zeros(0, np.int64)
        floor = -np.inf
        for at, n, lists, place, sparse, low, high in self.stretches:
            most = np.maximum(np.maximum(query * low, query * high), 0)
            order = np.argsort(most, kind="stable")
            upto = np.cumsum(most[order])
            cut = int(np.searchsorted(upto, floor, side="left")) if floor > -np.inf else 0
            others, essential = order[:cut][::-1], order[cut:]
            rest = upto[cut - 1] if cut else 0
            dense = essential[place[essential] >= 0]
            partial = _weighed(query[dense], lists[place[dense]])
            live = np.full(n, cut == 0 or len(dense) > 0)
            traversed = len(dense) * n
            if sparse:
                for t in essential:
                    if t in sparse:
                        held, value = sparse[t]
                        partial[held] += query[t] * value
                        live[held] = True
                        traversed += len(held)
            if seen is not None:
                seen.append(traversed)
            live &= partial + rest >= floor
            if skip is not None:
                live[skip[(skip >= at) & (skip < at + n)] - at] = False
            live = np.flatnonzero(live)
            partial = partial[live]
            for first in range(0, len(others), PROBE):
                terms = others[first : first + PROBE]
                rest -= most[terms].sum()
                dense = terms[place[terms] >= 0]
                partial = partial + _weighed(query[dense], lists[place[dense][:, None], live])
                for t in terms if sparse else ():
                    if t in sparse:
                        held, value = sparse[t]
                        found = np.minimum(np.searchsorted(held, live), len(held) - 1)
                        partial = partial + np.where(held[found] == live, value[found], 0) * query[t]
                keep = partial >= floor - max(rest, 0)
                live, partial = live[keep], partial[keep]
                if not len(live):
                    break
            scores, rows = np.append(scores, partial), np.append(rows, live + at)
            if len(scores) >= k:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= floor
                scores, rows = scores[keep], rows[keep]
        return scores, rows


def _weighed(weights: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The sum of the lists (terms x rows) by their weights; zeros without a term."""
    return weights @ lists if len(weights) else np.zeros(lists.shape[1], lists.dtype)


def _whole(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers."""
    return np.array([int(c) for c in x.ravel()], dtype=object).reshape(x.shape)


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    vectors = vectors.sort_values("vec_id", kind="stable")
    ids, times = vectors["vec_id"].to_numpy(), vectors["n"].to_numpy()
    x, q = np.stack(vectors["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    with np.errstate(over="ignore"):
        if (np.abs(q) @ np.abs(x).max(axis=0)).max() >= EXACT:
            x, q = _whole(x), _whole(q)
    index = Postings(x)
    for q_id, n, one in zip(queries["vec_id"], queries["n"], q, strict=True):
        own = np.arange(np.searchsorted(ids, q_id), np.searchsorted(ids, q_id, side="right"))
        scores, rows = index.top(one, k, own)
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k] if x.dtype == object else np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[best], [min(max(int(s), -LONG), LONG - 1) for s in scores[best]]
        yield pd.DataFrame({"query_id": q_id, "vec_id": ids[rows], "score": np.array(scores, np.int64), "times": np.minimum(times[rows] * n, k)})


def _cell(k: int):
    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = list(_best(queries, vectors, k)) if len(queries) and len(vectors) else []
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "times")})

    return run


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (whole numbers as array<double>), dim; only rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float("inf")))

    def floor(c: Column) -> Column:
        # Spark's floor gives a long; doubles from 2**53 on are whole as they are.
        return F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c)

    v = F.transform(x, lambda c: floor(c.cast("double") * scale))
    rows = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"))


def top_k(table: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """For each row of ``table`` (vec_id, embedding) that ``is_query`` picks, its k highest scores
    among all other rows: query_id, rank, vec_id, score."""
    vectors = integer_vectors(table).groupBy("vec_id", "v", "dim").agg(F.count(F.lit(1)).alias("n"))
    queries = vectors.where(is_query)
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("cell"), "v"), F.lit(n)).cast("int")
    left = queries.withColumn("block", own(blocks)).withColumn("shard", number(shards))
    right = vectors.withColumn("shard", own(shards)).withColumn("block", number(blocks))
    keys = ("block", "shard", "dim")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_cell(k), SCHEMA)
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
