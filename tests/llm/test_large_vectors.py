"""Scores beyond what doubles hold, and rows that repeat by thousands."""

import random

from pyspark.sql import functions as F

from leafmill.llm import maxscore as X


def brute(rows, k):
    whole = [(i, [int(256 * c // 1) for c in v]) for i, v in rows]
    out = []
    for q, a in ((i, v) for i, v in whole if i % 50 == 0):
        hits = [(sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q]
        out += [(q, r + 1, i, min(max(s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1]))[:k])]
    return sorted(out)


def check(spark, rows, k=5):
    got = X.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, k)


def test_scores_beyond_doubles(spark):
    g = random.Random(3)
    check(spark, [(i, [g.choice([0.0, 1.0, -1.0]) * g.randint(1, 2**20) + g.random() for _ in range(8)]) for i in range(150)])


def test_sparse_scores_beyond_doubles(spark):
    g = random.Random(4)
    check(spark, [(i, [float(g.randint(2**21, 2**22)) if g.random() < 0.2 else 0.0 for _ in range(12)]) for i in range(200)])


def test_scores_beyond_longs(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 2.0]), (2, [-1e20, 3.0]), (3, [0.5, 0.5])]
    check(spark, rows)
    scores = {r["vec_id"]: r["score"] for r in X.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert scores[1] == 2**63 - 1 and scores[2] == -(2**63) and scores[3] == 2**63 - 1


def test_equal_rows_are_one_in_a_shard(spark, monkeypatch):
    one = [(7, [1.0, 2.0, 3.0])] * 20_000
    rows = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 2.5]), *one], "vec_id long, embedding array<double>")
    got = X.top_k(rows, F.col("vec_id") == 0)
    assert [(r["rank"], r["vec_id"]) for r in got.orderBy("rank").collect()] == [(n, 7) for n in range(1, 6)]
    dealt = X.top_k(rows.where("vec_id = 7"), F.lit(True))
    assert dealt.count() == 0
