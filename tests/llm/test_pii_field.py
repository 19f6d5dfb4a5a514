"""The field on what the patterns miss: held-out phrases, whole tokens, long runs."""

import tracemalloc

import numpy as np
import pytest

from leafmill.llm import pii as P
from leafmill.llm.pii_examples import labelled_table


@pytest.fixture(scope="module")
def field():
    return P.train()


def test_held_out_phrases(field):
    rows = labelled_table(held=True)
    found = list(P._found([t for t, _ in rows], field, 0.9))
    right = wrong = by_model = 0
    for (text, spans), got in zip(rows, found, strict=True):
        for a, kind, b in got:
            hit = [s for s in spans if s[0] < b and s[1] > a and s[2] == P.KINDS[kind % 4]]
            wrong += not hit
        for a, b, kind in spans:
            hits = [k for x, k, y in got if x < b and y > a and P.KINDS[k % 4] == kind]
            right += bool(hits)
            by_model += any(k > 3 for k in hits)
    wanted = sum(len(s) for _, s in rows)
    assert right >= 0.7 * wanted and wrong <= 0.03 * right
    assert by_model >= 0.5 * wanted  # most of it is beyond the patterns


def test_planted_variants_become_spans(spark, field):
    texts = {
        1: ("please write to anna.lena [at] office [dot] org for details", "email"), 2: ("call (555) 010-9999 before noon", "phone"),
        3: ("the server 192[.]168[.]10[.]20 is down", "ip"), 4: ("charge card 4111-1111-1111-1111 or card number 4111.1111.1111.1111 expires", "card"),
        5: ("in the year 1984 it rained on 12 of 30 days, see page 7", None), 6: (None, None), 7: ("", None),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.pii_report(docs).collect()}
    for k, (_, kind) in texts.items():
        assert (got[k]["n_model"] > 0) == (kind is not None), (k, got[k]["spans"])
        assert kind is None or f"model_{kind}:" in got[k]["spans"]


def by_rule(text, reach):
    """Runs of tokens with a marked one among the ``reach`` tokens on either side, one token at a time."""
    tokens = [(m.start(), m.end()) for m in P._TOKEN.finditer(text)]
    cues = [(m.start(), m.end()) for m in P._CUES.finditer(text)]
    marked = [any(a < e and b > s for a, b in cues) for s, e in tokens]
    near = [any(marked[max(0, k - reach) : k + reach + 1]) for k in range(len(tokens))]
    runs, last = [], False
    for t, n in zip(tokens, near):
        if n and last:
            runs[-1].append(t)
        elif n:
            runs.append([t])
        last = n
    return runs


def test_zones(rng):
    say = ["a", "bb", "dot", "7", "x@y", "[at]", "word", "(dot)", "..", "dots", "ü"]
    for _ in range(3000):
        text = rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choice(say[:2] * 4 + say) for _ in range(rng.randrange(40)))
        assert [r.places() for r in P.zones(text)] == by_rule(text, P.REACH), text


def test_features_read_whole_tokens():
    long = "1" * 100
    a, b = (P.run_features(t, [(0, len(t))]) for t in (long + "x" * 10, long + "y-1"))
    assert a != b
    c, d = (P.run_features(t, [(0, len(t))]) for t in (long, long + "1"))
    assert c != d  # the digits are counted to the end


def test_long_runs_in_pieces(monkeypatch, field):
    g = np.random.default_rng(2)
    text = " ".join(g.choice(["call", "(555)", "010-9999", "7", "at", "anna", "dot", "org", "192[.]168[.]0[.]1", "card", "4111", "1111"], 500))
    run = max(P.zones(text, field.words), key=len)
    rows = run.rows(0, len(run))
    whole = field.decode([run])[0]
    monkeypatch.setattr(P, "LONG", 37)
    for pieces in (field.decode([run])[0], field.decode([rows])[0]):
        assert (pieces[0] == whole[0]).all() and np.abs(pieces[1] - whole[1]).max() < 1e-6
    assert whole[0].any()


def test_long_runs_take_little_memory(field, monkeypatch):
    """Beside the text and the caches of a fixed size, some bytes a token; brief runs are decoded in batches."""
    monkeypatch.setattr(P, "_short_row", P._hashed)
    monkeypatch.setattr(P, "_short_shape", P._shaped)
    n = 40_000
    text = " ".join(str(k) for k in range(n))
    for t in (text, " ".join(f"{k} a b c d e f g" for k in range(n // 8))):
        list(P._found([t[:2000]], field, 0.9))
        tracemalloc.start()
        list(P._found([t], field, 0.9))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12_000_000 + 100 * n


def test_an_empty_table_finds_nothing(spark):
    field = P.train([])
    docs = spark.createDataFrame([(1, "call (555) 010-9999 or a@b.org")], "doc_id long, text string")
    assert [[s["kind"] for s in r["found"]] for r in P.scan_pii(docs, field).collect()] == [["email"]]
