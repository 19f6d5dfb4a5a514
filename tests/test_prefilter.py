"""Random-projection buckets: recall and price against exact search, what is read, and edge cases."""

import math

import numpy as np
import pytest

from leafmill.operators import prefilter as P
from leafmill.operators import retrieval as R
from leafmill.plans.fixtures import fixture

SCHEMA = "chunk_id string, embedding array<double>"


def clustered(n, clusters=60, dim=32, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"c{k:05d}", v) for k, v in enumerate(clustered(4000))]
    c = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(k, f"c{k:05d}", rows[k][1]) for k in range(0, 4000, 50)], "query_id long, own string, embedding array<double>")
    return q, c


def totals(report):
    rows = report.collect()
    return [sum(r[n] for r in rows) for n in ("n_exact", "n_found", "n_examined")]


def test_recall_and_price_on_clusters(tables, tmp_path):
    q, c = tables
    P.write_index(c, f"{tmp_path}/i", bits=6)
    exact, found, seen = totals(P.search_report(q, c, f"{tmp_path}/i", skip="own"))
    assert exact == 80 * 8 and found >= 0.9 * exact
    assert seen <= 0.35 * 80 * 4000


def test_recall_on_every_fiftieth_vector(spark, sf_dir, tmp_path):
    """The given vectors lie nearly at random, so most rows are looked into; the recall holds all the same."""
    q, c = fixture(spark, sf_dir, "queries"), fixture(spark, sf_dir, "chunk_store")
    P.write_index(c, f"{tmp_path}/i", bits=5)
    exact, found, _ = totals(P.search_report(q, c, f"{tmp_path}/i", skip="own_chunk"))
    assert exact > 0 and found >= 0.9 * exact


def test_what_is_found_is_exact_and_only_its_folders_are_read(spark, tables, tmp_path):
    q, c = tables
    path = f"{tmp_path}/i"
    settings = P.write_index(c, path, bits=6)
    one = q.where("query_id = 100")
    reached = sorted(r["bucket"] for r in P.probes(P.bucketed(one, settings.bits), settings.reach).collect())
    read = P.read_rows(spark, path, reached)
    scan = read._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [bucket" in scan.toString()
    read.collect()
    leaf = scan.collectLeaves().head()
    folders = P.read_rows(spark, path).select("bucket").distinct().count()
    assert 0 < leaf.selectedPartitions().partitionCount() <= len(reached) < folders
    assert sum(1 for _ in P.read_rows(spark, path).select("chunk_id").distinct().collect()) == 4000

    own = P.read_rows(spark, path, reached).join(c.select("chunk_id"), "chunk_id")
    want = [(r["chunk_id"], r["score"]) for r in R.retrieve_top_k(one, own, 8, skip="own").orderBy("rank").collect()]
    assert [(r["chunk_id"], r["score"]) for r in P.search_index(one, path, skip="own").orderBy("rank").collect()] == want


def test_probes_equal_all_buckets_in_reach(spark, tables):
    q, _ = tables
    bits = 6
    rows = P.bucketed(q, bits).collect()
    for reach in (0.0, 0.4, 2.5, math.inf):
        got = {}
        for r in P.probes(P.bucketed(q, bits), reach).collect():
            got.setdefault(r["query_id"], []).append(r["bucket"])
        for r in rows:
            p = r["products"]
            assert r["bucket"] == sum(1 << i for i, x in enumerate(p) if x > 0)
            want = [b for b in range(1 << bits) if sum(x * x for i, x in enumerate(p) if (b ^ r["bucket"]) >> i & 1) <= reach]
            assert sorted(got[r["query_id"]]) == want


def test_fit_on_a_sample(tables, tmp_path):
    """A fit on an eighth of the rows looks into no less than the share asked for."""
    q, c = tables
    path = f"{tmp_path}/i"
    P.write_index(c, path, bits=6, sample_rows=500, sample_queries=60)
    exact, found, _ = totals(P.search_report(q, c, path, skip="own"))
    assert found >= 0.9 * exact


def test_hot_vector_is_whole(spark, tmp_path, monkeypatch):
    """A third of all rows are one vector: its bucket is cut into shards, and all its rows are ranked."""
    monkeypatch.setattr(R, "SHARD", 50)
    rng = np.random.default_rng(1)
    same = [1.0] + [0.0] * 15
    rows = [(f"a{k:04d}", rng.normal(size=16).tolist()) for k in range(600)] + [(f"h{k:04d}", same) for k in range(300)]
    path = f"{tmp_path}/i"
    P.write_index(spark.createDataFrame(rows, SCHEMA), path, bits=5)
    q = spark.createDataFrame([(1, same)], "query_id long, embedding array<double>")
    ids = {r["chunk_id"] for r in P.search_index(q, path, k=2000).collect()}
    assert {f"h{k:04d}" for k in range(300)} <= ids


def test_edge_cases(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [1.0])], "query_id long, embedding array<double>")
    P.write_index(empty, f"{tmp_path}/none")
    assert P.search_index(q, f"{tmp_path}/none").count() == 0
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [None, 1.0]), ("e", [math.inf, 0.0]), ("f", [0.0, 0.0]), (None, [1.0, 0.0]), ("g", [2.0])]
    settings = P.write_index(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/few", bits=3)
    assert settings == P.read_settings(spark, f"{tmp_path}/few")
    assert {r["chunk_id"] for r in P.read_rows(spark, f"{tmp_path}/few").collect()} == {"a", "b", "f", "g"}
    got = {}
    for r in P.search_index(q, f"{tmp_path}/few").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert set(got) <= {1, 2, 5} and sorted(got[2]) == ["a", "b", "f"] and "a" in got[1] and got[5] == ["g"]
    P.write_index(spark.createDataFrame(rows[:1], SCHEMA), f"{tmp_path}/one")
    assert [r["chunk_id"] for r in P.search_index(q.where("query_id = 1"), f"{tmp_path}/one").collect()] == ["a"]
