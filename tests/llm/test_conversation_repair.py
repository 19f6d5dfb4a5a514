"""Repairs against a search over all edits, row by row."""

import hashlib
import heapq
import random
from zlib import crc32

import pytest

from leafmill.llm import conversation_repair as R

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def best_edits(rows):
    """rows: (role, text, fault). Cheapest first audit by Dijkstra over (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, n, state, out = heapq.heappop(heap)
        if (n, state) in done:
            continue
        done.add((n, state))
        if n == len(rows) and state in ("", "a"):
            return cost, audit, out
        new = "a" if state == "u" else "u"
        role = {"a": "assistant", "u": "user"}[new]
        heapq.heappush(heap, (cost + 5, audit + "I", n, new, (*out, role + ":")))
        if n < len(rows):
            was, text, fault = rows[n]
            heapq.heappush(heap, (cost + 2, audit + "D", n + 1, state, out))
            if fault not in ("b", "d"):
                late = 5 * (fault == "t")
                heapq.heappush(heap, (cost + late + 1, audit + "R", n + 1, new, (*out, role + ":" + text)))
                if (state, was[:1]) in LEADS:
                    heapq.heappush(heap, (cost + late, audit + "K", n + 1, was[:1], (*out, was + ":" + text)))


def expected(conv_id, rows):
    said = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = (" " if conv_id is None else str(conv_id)) + ":" + (" " if turn is None else str(turn))
        hit = crc32(key.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else text.translate({ord(c): None for c in ".!?"}) if hit == 2 else text
        said += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
    seen, marked = set(), []
    for _, role, text in said:
        bare = text.rstrip(SPACES)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, out = best_edits(marked)
    turns = [t for t, _, _ in said if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    ini = [r[0][:1] for r in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:], strict=False))
    count = [sum(r[2] == f for r in marked) for f in "bdt"]
    return (conv_id, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(rng, n, most):
    rows = []
    for c in range(n):
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", "", " \n", None, f"w{rng.randrange(99)}. ", "x.\n"])
            rows.append((rng.choice([c, c, c, None]) if c % 9 == 0 else c, rng.choice([None, *range(most)]), role, text))
    return rows


def check(spark, rows):
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(row)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, word string, block long")
    got = R.repair_report(df.repartition(5))
    assert got.columns == COLUMNS
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(c, x) for c, x in by.items()), key=key)


def test_all_edits(spark):
    check(spark, conversations(random.Random(5), 150, 9))


def test_long_conversations_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BITS", 2)
    monkeypatch.setattr(R, "FOLD", 3)
    check(spark, conversations(random.Random(6), 12, 70))


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(7)
    rows = conversations(rng, 6, 9) + [(None, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", f"c{t}.", "d"])) for t in range(900)]
    check(spark, rows)


def test_rows_that_repeat_and_a_conversation_that_goes(spark):
    gone = next(c for c in range(10_000) if crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi.")] + [(1, 3, "user", "Hi.")] * 400 + [(2, None, None, None)] * 3
    check(spark, rows)
    assert expected(gone, [(0, "user", "Hi.")])[5:] == (0, 0, "", hashlib.sha256().hexdigest())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair_report(empty).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_tables_of_words_multiply(seed):
    rng = random.Random(seed)
    for _ in range(60):
        word = "".join(rng.choice("suaxSUAX0123") for _ in range(rng.randrange(1, 12)))

        def table(w):
            out = R.EMPTY
            for c in reversed(w):
                out = R.longer(c, out)
            return out

        cut = rng.randrange(len(word))
        assert R.joined(table(word[:cut]), table(word[cut:])) == table(word)


def test_a_suffix_is_worked_out_once(monkeypatch):
    import pandas as pd

    calls = []
    real = R.longer
    monkeypatch.setattr(R, "longer", lambda c, t: calls.append(c) or real(c, t))
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("suaU") for _ in range(rng.randrange(1, 7))) for _ in range(500)}, key=lambda w: w[::-1])
    list(R.automaton(iter([pd.DataFrame({"word": words[:90]}), pd.DataFrame({"word": words[90:]})])))
    assert len(calls) == len({w[k:] for w in words for k in range(len(w))})


def test_repaired_rows_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be."), (2, 1, "assistant", "A.")]
    got = R.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv", "nth").collect()
    # Either question may go; deleting the first comes first in ASCII order.
    assert [tuple(r) for r in got] == [("=1", 0, "user", "There."), ("=1", 1, "assistant", "Yes."), ("=2", 0, "user", "Be."), ("=2", 1, "assistant", "A.")]


def test_oracle(spark, sf_dir, same_rows):
    same_rows(R.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet")), R.ORACLE)
