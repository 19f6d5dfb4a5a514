import hashlib
import random
import re

import numpy as np
from itertools import product

from leafmill.llm import pii as P

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check(df):
    rows = df.select("doc_id", "text").collect()
    got = P.pii_report(df).collect()
    want = []
    for r in rows:
        b = brute(r["text"])
        text = ",".join(f"{P.KINDS[k]}:{a}:{z}" for a, k, z in b)
        want.append(str((r["doc_id"], hashlib.sha256(text.encode()).hexdigest(), [sum(k == n for _, k, _ in b) for n in range(4)])))
    assert sorted(str((r["doc_id"], r["base_sha256"], [r[f"n_{k}"] for k in P.KINDS])) for r in got) == sorted(want)
    return got


def test_documents(documents):
    got = check(documents)
    assert sum(r["n_email"] + r["n_phone"] for r in got) > 0


def test_edges(edge, nothing):
    check(edge)
    assert P.pii_report(nothing).count() == 0


def test_patterns_equal_regex():
    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choice("ab1.@+- (2é") for _ in range(r.randint(0, 40)))
        assert brute(t) == P.pattern_spans(t), t
    for t in ("a" * 100_000, "1" * 100_000, "@" * 100_000, "1." * 50_000, "+1" * 50_000):
        P.pattern_spans(t)


def all_paths(f, rows):
    e = f.w[np.array(rows)].sum(axis=1)
    t = f.t + f.ban
    best, total = None, []
    for path in product(range(P.LABELS), repeat=len(rows)):
        s = t[0, path[0]] + sum(e[k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])) + t[path[-1], 0]
        total.append(s)
        if best is None or s > best[0]:
            best = (s, path)
    return best[1], np.logaddexp.reduce(total)


def test_viterbi_equals_all_paths():
    g = np.random.default_rng(1)
    f = P.Field()
    f.w = g.normal(size=f.w.shape)
    f.t = g.normal(size=f.t.shape)
    runs = [g.integers(0, P.FEATURES, (n, P.WIDTH)).tolist() for n in (1, 2, 3, 4, 1, 3)]
    for run, (labels, sure) in zip(runs, f.decode(runs)):
        path, z = all_paths(f, run)
        assert tuple(labels) == path and (sure <= 1 + 1e-9).all()
        rows, n = P._padded([run])
        assert abs(f._passes(f.w[rows].sum(axis=2), n)[3][0] - z) < 1e-8


def test_field_learns_its_table(spark, sf_dir):
    """Held-out accuracy; the smallest table has too few runs to learn from."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("text").collect()]
    runs, labels = [], []
    for t in texts:
        spans = P.pattern_spans(t)
        for run in P.token_runs(t):
            runs.append(P.run_features(t, run))
            labels.append(P.run_labels(run, spans))
    cut = len(runs) * 2 // 3
    f = P.Field().fit(runs[:cut], labels[:cut])
    got = f.decode(runs[cut:])
    right = sum(int((a == np.array(b)).sum()) for (a, _), b in zip(got, labels[cut:]))
    assert right >= 0.9 * sum(map(len, labels[cut:]))


def test_runs_cover_tokens():
    t = "call +1 (555) 010-9999 or mail a.b@c.org, x 7"
    assert [[t[a:b] for a, b in r] for r in P.token_runs(t)] == [["+1", "(555)", "010-9999"], ["a.b@c.org,"], ["7"]]
