"""Preference rows for every conversation."""

from leafmill.llm import chat_format as C
from leafmill.llm.registry import oracle_sql, queries


def test_every_conversation_has_a_row(spark, sf_dir, same_rows):
    rows = queries()["op4_preference_pairs"](spark, sf_dir)
    same_rows(rows, oracle_sql()["op4_preference_pairs"])
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r["pair_id"]: r for r in rows.collect()}
    assert got.keys() == turns.keys()
    places = set()
    for k, r in got.items():
        said = [f"<|{role}|>\n{text}<|end|>\n" for _, role, text in sorted(turns[k])]
        assert r["prompt"] + r["chosen"] == "".join(said)
        answers = sum(role == "assistant" for _, role, _ in turns[k])
        cut = r["prompt"].count("<|end|>\n")
        assert (r["chosen_loss"] == "") == (answers == 0)
        for part in ("chosen", "rejected"):
            spans = [r[part][int(a) : int(b)] for a, b in (s.split(":") for s in r[f"{part}_loss"].split(",") if s)]
            assert len(spans) == sum(x.startswith("<|assistant|>") for x in said[cut:])
            assert all(x.startswith("<|assistant|>\n") and x.endswith("<|end|>\n") for x in spans)
        if answers > 1:
            places.add(sum(x.startswith("<|assistant|>") for x in said[cut:]))
    assert {1, 2} < places


def test_few_answers_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, cut int, said int"
    rows = [(1, 0, "user", "q"), (1, 3, "assistant", "a"), (1, 5, "user", "thanks"), (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (4, 0, None, None),
            (5, 0, "user", "echo"), (5, 1, "assistant", "echo"), (None, 0, "user", "x"), (1, None, "user", "x"), (1, 3, "assistant", "a")]
    got = {r["pair_id"]: tuple(r)[1:] for r in C.preference_rows(spark.createDataFrame([(*r, 1, 1) for r in rows], schema)).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    a, q, e = say("assistant", "a"), say("assistant", "q"), say("assistant", "")
    assert got == {
        1: (say("user", "q"), a + say("user", "thanks"), q + say("user", "thanks"), f"0:{len(a)}", f"0:{len(q)}"),
        2: (say("user", "alone"), "", "", "", ""), 3: ("", say("assistant", "first"), e, f"0:{len(a) + 4}", f"0:{len(e)}"), 4: (say("", ""), "", "", "", ""),
        5: (say("user", "echo") + say("assistant", "echo"), "", "", "", "")}
    assert C.preference_rows(spark.createDataFrame([], schema)).count() == 0
