import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import retrieval as R

rng = np.random.default_rng(3)


def unit(n, d=8):
    v = rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


CHUNKS = [(f"c{k:03d}", f"s{k % 3}", f"t{k}", v) for k, v in enumerate(unit(120))] + [("dup", "s0", "t0", None)]
QUERIES = [(k, v) for k, v in enumerate(unit(7))]


@pytest.fixture(scope="module")
def tables(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_id string, source string, text string, embedding array<double>")
    q = spark.createDataFrame(QUERIES, "query_id long, embedding array<double>")
    return q, c


def brute(k, source=None):
    out = {}
    for qid, q in QUERIES:
        sims = sorted(((-round(float(np.dot(q, v)), 12), cid) for cid, s, _, v in CHUNKS if v and source in (None, s)))
        out[qid] = [(cid, -s) for s, cid in sims[:k]]
    return out


def hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def test_top_k_filter_and_blocks(tables, monkeypatch):
    q, c = tables
    want = {k: [(i, round(s, 4)) for i, s in v] for k, v in brute(8).items()}
    assert hits(R.retrieve_top_k(q, c, 0)) == want
    monkeypatch.setattr(R, "SHARD", 16)
    monkeypatch.setattr(R, "BLOCK", 2)
    assert hits(R.retrieve_top_k(q, c)) == want
    own = {k: [i for i, _ in v] for k, v in brute(4, "s1").items()}
    assert {k: [i for i, _ in v] for k, v in hits(R.retrieve_top_k(q, R.filter_source(c, "s1"), 4)).items()} == own


def test_threshold_rounds_first(spark):
    c = spark.createDataFrame([("a", "s", "t", [0.34996, 0.0]), ("b", "s", "t", [0.34994, 0.0])], "chunk_id string, source string, text string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [i for i, _ in hits(R.retrieve_threshold(q, c, threshold=0.35))[1]] == ["a"]
    assert R.retrieve_mmr(q, c, threshold=0.35).count() == 0


def test_mmr_equals_model(tables):
    q, c = tables
    vec = {cid: np.array(v) for cid, _, _, v in CHUNKS if v}
    got = hits(R.retrieve(q, c, "mmr", k=5, weight=0.5, threshold=0.1))
    for qid, near in brute(30).items():
        cand, picked = [(i, s) for i, s in near if s >= 0.1], []
        while cand and len(picked) < 5:
            value = [round(0.5 * s - 0.5 * max((float(vec[i] @ vec[p]) for p in picked), default=0.0), 12) for i, s in cand]
            picked.append(cand.pop(int(np.argmax(value)))[0])
        assert [i for i, _ in got.get(qid, [])] == picked
    assert hits(R.retrieve_mmr(q, c, k=8, weight=1.0, threshold=-1.0)).keys() == brute(8).keys()
    assert {k: [i for i, _ in v] for k, v in hits(R.retrieve_mmr(q, c, k=8, weight=1.0, threshold=-1.0)).items()} == {k: [i for i, _ in v] for k, v in brute(8).items()}


def test_modes_and_diagnostics(tables):
    q, c = tables
    with pytest.raises(ValueError, match="top_k, threshold, mmr"):
        R.retrieve(q, c, "nearest")
    found = R.retrieve_threshold(q, c, threshold=0.7)
    missing = {r["query_id"] for r in R.no_context(q, found).collect()}
    assert missing == {k for k, v in brute(1).items() if round(v[0][1], 4) < 0.7}
    sweep = {r["threshold"]: (r["accepted"], r["rejected"]) for r in R.threshold_sweep(R.raw_top3(q, c), [0.7, -1.0]).collect()}
    assert sweep == {0.7: (7 - len(missing), len(missing)), -1.0: (7, 0)}
    assert R.retrieve_top_k(q.where(F.lit(False)), c).count() == 0


def test_scopes_are_searched_apart(spark, tables, monkeypatch):
    """Queries with a scope see its chunks alone, one without sees all; scopes without queries are not scored."""
    _, c = tables
    vec = dict(QUERIES)
    rows = [(k, ["s0", "s1", None, "none"][k % 4], vec[k]) for k in vec]
    q = spark.createDataFrame(rows, "query_id long, source string, embedding array<double>")
    for shard, block in ((16384, 1024), (8, 1)):
        monkeypatch.setattr(R, "SHARD", shard)
        monkeypatch.setattr(R, "BLOCK", block)
        got = {k: [i for i, _ in v] for k, v in hits(R.retrieve_top_k(q, c, 4, scope="source")).items()}
        want = {k: [i for i, _ in brute(4, s)[k]] for k, s, _ in rows if s != "none"}
        assert got == want


def test_a_query_leaves_its_own_chunk_out(spark, tables):
    _, c = tables
    rows = [(k, f"c{k:03d}", CHUNKS[k][3]) for k in range(5)]
    q = spark.createDataFrame(rows, "query_id long, own string, embedding array<double>")
    for k, found in hits(R.retrieve_top_k(q, c, 3, skip="own")).items():
        sims = sorted((-round(float(np.dot(CHUNKS[k][3], v)), 12), cid) for cid, _, _, v in CHUNKS if v and cid != f"c{k:03d}")
        assert [i for i, _ in found] == [cid for _, cid in sims[:3]]
    assert all(v[0][0] == f"c{k:03d}" for k, v in hits(R.retrieve_top_k(q, c, 3)).items())


def test_a_cell_never_holds_all_its_scores():
    table = lambda n, name, extra: pa.table({name: list(range(n)) if name == "query_id" else [f"c{i:05}" for i in range(n)], "v": list(rng.normal(size=(n, 8))), **extra})
    queries = table(1024, "query_id", {"skip": ["c00007"] + [None] * 1023})
    chunks = table(16384, "chunk_id", {})
    tracemalloc.start()
    got = R._cell(3)((), queries, chunks).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores are 134 MB
    scores = np.stack(queries["v"].to_pylist()) @ np.stack(chunks["v"].to_pylist()).T
    scores[0, 7] = -np.inf
    assert [r["chunk_id"] for r in got] == [f"c{i:05}" for row in scores for i in np.argsort(-row)[:3]]
