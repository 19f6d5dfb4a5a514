"""What MaxScore traverses: whole lists at first, then those of the essential terms alone."""

import numpy as np
import pytest

from leafmill.llm import maxscore as X


def plain(x, q, k, skip):
    scores = x @ q
    order = sorted((i for i in range(len(x)) if i not in skip), key=lambda i: (-scores[i], i))
    return [(scores[i], i) for i in order[:k]]


@pytest.mark.parametrize("full", [True, False])
def test_lists(monkeypatch, full):
    monkeypatch.setattr(X, "STRETCH", 64)
    g = np.random.default_rng(5)
    x = np.floor(g.normal(size=(600, 40)) * 50)
    if not full:
        x[g.random(x.shape) < 0.85] = 0
    x[::50] *= 3
    index = X.Postings(x)
    saved = 0
    for n in range(40):
        q = np.floor(g.normal(size=40) * 50 * g.pareto(1.0, 40))
        seen = []
        scores, rows = index.top(q, 4, np.array([n, n + 1]), seen)
        best = sorted(zip(-scores, rows))[:4]
        assert [(-s, r) for s, r in best] == plain(x, q, 4, {n, n + 1})
        lists = [int((x[a : a + 64] != 0).sum()) if not full else x[a : a + 64].size for a in range(0, 600, 64)]
        assert seen[0] == lists[0] and all(s <= m for s, m in zip(seen, lists))
        saved += sum(lists) - sum(seen)
    assert saved > 0.3 * 40 * sum(lists)


def test_few_rows_and_flat_scores():
    x = np.zeros((5, 3))
    scores, rows = X.Postings(x).top(np.ones(3), 2)
    assert scores.tolist() == [0.0] * 5 and rows.tolist() == [0, 1, 2, 3, 4]
    scores, rows = X.Postings(-np.ones((3, 2))).top(np.ones(2), 9, np.array([1]))
    assert sorted(rows.tolist()) == [0, 2] and set(scores) == {-2.0}
