"""Runs against a search over all periods and positions."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from leafmill.llm import periodic_runs as P


def brute(x):
    n, out = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def text_words(rng, n, letters):
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p, k = rng.randrange(n), rng.randrange(1, 9), rng.randrange(2, 9)
        x[a:a] = x[a : a + p] * k
    return x


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(120):
        x = text_words(rng, rng.randrange(1, 90), rng.choice([1, 2, 3, 30]))
        assert P.runs(np.unique(x, return_inverse=True)[1]) == brute(x), x


def test_all_words_alike_and_periods_of_periods():
    assert P.runs(np.zeros(5000, np.int64)) == [(0, 5000, 1)]
    assert P.runs(np.array(([0, 0, 1] * 4 + [2]) * 5)) == brute(([0, 0, 1] * 4 + [2]) * 5)
    assert P.runs(np.array([0, 1] * 3)) == []  # six words, but not four periods
    assert P.runs(np.array([0] * 5)) == []
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert P.runs(np.array(b * 5)) == brute(b * 5)


def test_blocks_of_positions_keep_order():
    rng = random.Random(3)
    at = rng.sample(range(100_000), 6000)
    own, seen = P.Positions(at[0]), [at[0]]
    for k, x in enumerate(at[1:]):
        before, behind = own.add(x)
        if k % 50 == 0:
            assert before == max((y for y in seen if y < x), default=None)
            assert behind == min((y for y in seen if y > x), default=None)
        seen.append(x)
    assert list(own) == sorted(at)


def expected(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    row = (best[0][0], best[0][1], best[0][2], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
order = lambda r: (r[0] is None, r[0] or 0, r)


def test_report_against_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    rows = [r for r in rows if len((r[1] or "").split()) <= 1500]
    got = P.run_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=order) == sorted((expected(*r) for r in rows), key=order)
    assert sum(r["n_runs"] > 0 for r in got) > len(got) // 20


def test_edges(spark, edge, nothing):
    got = P.run_report(edge)
    assert got.columns == COLUMNS
    rows = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert got.count() == edge.count()
    assert rows[1]["n_runs"] == rows[2]["n_runs"] == rows[3]["n_runs"] == 0 and rows[1]["start"] is None
    assert rows[1]["collapsed_sha256"] == hashlib.sha256().hexdigest()
    assert rows[4]["n_runs"] == 1 and rows[4]["start"] == 0  # nine words, nine thousand times
    assert P.run_report(nothing).count() == 0 and P.run_report(nothing).columns == COLUMNS


def test_white_space_is_ascii_only(spark):
    text = " ".join(["a b c"] * 8)  # one word with a no-break space, then c
    got = P.run_report(spark.createDataFrame([(11, text)], "doc_id long, text string")).first()
    assert tuple(got) == expected(11, text)
