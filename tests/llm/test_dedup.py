import hashlib
import re

import numpy as np

from leafmill.llm import exact_dedup as E
from leafmill.llm import minhash as M
from leafmill.llm.components import connected_components
from leafmill.llm.registry import oracle_sql
from leafmill.llm.word_hash import shingle_set, word_hashes


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_exact(df):
    rows = df.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r["doc_id"])
    want = []
    for r in rows:
        own = groups[norm(r["text"])]
        keep = min((d for d in own if d is not None), default=None)
        want.append(str((r["doc_id"], keep, len(own), r["doc_id"] == keep, hashlib.sha256(norm(r["text"]).encode()).hexdigest())))
    got = [str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in E.exact_dedup(df).collect()]
    assert sorted(got) == sorted(want)


def test_exact(documents, edge, nothing, spark, rng):
    check_exact(documents)
    check_exact(edge)
    assert E.exact_dedup(nothing).count() == 0
    rows = [(k, f"t{rng.choice([0, 0, 0, 0, 1, 2, k])}") for k in range(3000)]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))


def test_filters_merge_losslessly(spark):
    g = np.random.default_rng(4)
    fps = np.concatenate([g.integers(-(1 << 63), (1 << 63) - 1, 2000), g.integers(0, 50, 3000)]).tolist()
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(7)
    for bits in (0, 3, 8):
        merged = E.merge_filters(E.build_filters(df, bits, flush=500))
        got = {}
        for r in merged.collect():
            f, c = E.entries(r.asDict())
            assert (np.diff(f.astype(object)) > 0).all()
            got |= dict(zip(f.view(np.int64).tolist(), c.tolist()))
        want = {x: fps.count(x) for x in set(fps)}
        assert got == want
        assert {r["fp"] for r in E.counted_above(merged).collect()} == {x for x, n in want.items() if n > 1}


def words(t):
    t = "".join(c.lower() if c.isascii() else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingles(t, width):
    w = words(t)
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def brute_components(rows, width, percent=80):
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check_near(df, width):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute_components([r for r in rows if r[0] is not None], width)
    got = M.near_duplicates(df, width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_documents(documents, same_rows):
    same_rows(M.near_duplicates(documents, 2), oracle_sql()["op5_near_duplicates"])
    check_near(documents, 5)


def test_near_edges(edge, nothing):
    check_near(edge, 2)
    assert M.near_duplicates(nothing, 2).count() == 0


def test_near_families(spark, rng):
    """A dense family around the threshold, chains, short texts, and texts that share a passage."""
    vocab = [f"w{k}" for k in range(4000)]
    rows = []
    base = [rng.choice(vocab) for _ in range(90)]
    for k in range(220):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append(" ".join(t))
    chain = [rng.choice(vocab) for _ in range(60)]
    for k in range(25):
        chain = list(chain)
        chain[(k * 2) % 60] = f"c{k}"
        rows.append(" ".join(chain))
    passage = [rng.choice(vocab) for _ in range(50)]
    for k in range(60):
        rows.append(" ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(5, 40))]))
    for k in range(60):
        rows.append(" ".join(rng.choice(vocab[:4]) for _ in range(rng.randint(1, 9))))
    rng.shuffle(rows)
    check_near(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 2)


def test_hashes_do_not_depend_on_cuts(monkeypatch):
    import leafmill.llm.word_hash as H

    texts = ["a bb\tccc  Ädd é", None, "", "x " * 700, "y" * 300 + " z"]
    whole = [h.tolist() for _, run in word_hashes(texts) for h in run]
    assert [len(x) for x in whole] == [5, 0, 0, 700, 2]
    monkeypatch.setattr(H, "SEGMENT", 64)
    assert [h.tolist() for _, run in word_hashes(texts) for h in run] == whole


def test_estimate_is_close():
    g = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        off = []
        for _ in range(20):
            both = g.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
            n = int(3000 * share)
            rest = (3000 - n) // 2
            a, b = np.sort(both[: n + rest]), np.sort(np.concatenate([both[:n], both[n + rest :]]))
            ra, rb = M.registers([a, b])
            off.append(M.estimate(ra.astype(">u2").tobytes(), rb.astype(">u2").tobytes(), len(a), len(b)) - share)
        assert abs(np.mean(off)) < 0.03 and np.abs(off).max() < 0.15
    assert len(shingle_set(np.zeros(0, np.uint64), 2)) == 0


def test_components(spark, rng):
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
