import json

import pytest

from leafmill.operators import quiz as Q
from leafmill.operators import reports

GOOD = {"question": "Why?", "options": {"A": "1", "B": "2", "C": "3", "D": "4"}, "correct": "B", "explanation": "Because it is so."}


def bad(**changes):
    out = {k: v for k, v in {**GOOD, **changes}.items() if v != "DROP"}
    return json.dumps([out])


CASES = [
    (json.dumps([GOOD]), None), ("```json\n" + json.dumps([GOOD]) + "\n```", None), ("Sure: " + json.dumps([GOOD]) + " ok", None),
    ("[]", None), ("nothing", "parse error"), ('[{"a": NaN}]', "parse error"), (json.dumps(GOOD), "not a list"), ("[1]", "not a dict"),
    (bad(question="DROP"), "missing question"), (bad(question=None), "question not a non-blank string"), (bad(question=5), "question not a non-blank string"),
    (bad(question="  "), "question not a non-blank string"), (bad(options="DROP"), "missing options"), (bad(options=["A"]), "options not a dict"),
    (bad(options={"A": "1", "B": "2", "C": "3"}), "option keys not A-D"), (bad(options={**GOOD["options"], "E": "5"}), "option keys not A-D"),
    (bad(options={**GOOD["options"], "C": 7}), "option C not a non-blank string"), (bad(options={**GOOD["options"], "B": " "}), "option B not a non-blank string"),
    (bad(correct="DROP"), "missing correct"), (bad(correct="E"), "correct not in A-D"), (bad(correct=["A"]), "correct not in A-D"),
    (bad(explanation="DROP"), "missing explanation"), (bad(explanation=5), "explanation not a string"), (bad(explanation=" short   "), "explanation too short"),
    (bad(extra=1), None),
]


def test_validation_order(spark):
    df = spark.createDataFrame([(k, 1, c) for k, (c, _) in enumerate(CASES)], "request_id int, attempt int, raw_response string")
    got = {r["request_id"]: r["error"] for r in Q.validate_replies(df).collect()}
    for k, (case, want) in enumerate(CASES):
        assert got[k] == want, case


def test_first_bad_item_rejects_all(spark):
    raw = json.dumps([GOOD, {**GOOD, "correct": "Z"}, {}])
    row = Q.validate_replies(spark.createDataFrame([(1, 1, raw)], "request_id int, attempt int, raw_response string")).first()
    assert (row["error"], row["error_index"], row["n_items"]) == ("correct not in A-D", 1, 3)


def test_attempts(spark):
    ok, no = json.dumps([GOOD, GOOD]), "no"
    rows = [(1, 1, no), (1, 2, ok), (2, 1, no), (2, 2, "[]"), (2, 3, ok), (3, 1, no), (3, 2, no), (3, 3, "[1]"), (3, 4, ok)]
    sel = Q.select_attempt(Q.validate_replies(spark.createDataFrame(rows, "request_id int, attempt int, raw_response string")))
    got = {r["request_id"]: (r["attempt"], r["status"], r["error"]) for r in sel.collect()}
    assert got == {1: (2, "valid", None), 2: (2, "empty", None), 3: (3, "failed", "not a dict")}
    questions = Q.number_questions(sel)
    assert [(r["id"], r["source_chunks"]) for r in questions.orderBy("id").collect()] == [(1, []), (2, [])]
    hits = spark.createDataFrame([(1, "a.pdf", 3), (1, "a.pdf", 3), (1, "a.pdf", 4)], "request_id int, source string, page_start int")
    cited = Q.attach_source_chunks(questions, hits)
    requests = spark.createDataFrame([(1, "d", "topic")], "request_id int, doc_id string, topic string")
    made = Q.assemble_quiz(cited, requests).first()
    assert made["questions"][1]["source_chunks"] == ["a.pdf:p3", "a.pdf:p4"] and made["questions"][0]["options"]["D"] == "4"


def test_requests_prompts_and_generation(spark):
    req = spark.createDataFrame([(1, "d", "t", None, None), (2, "d", "t", 0, "easy"), (3, None, "t", 5, "easy"), (4, "d", "t", 20, "odd")],
                                "request_id int, doc_id string, topic string, num_questions int, difficulty string")
    got = {r["request_id"]: r["reject_reason"] for r in Q.validate_requests(req).collect()}
    assert got == {1: None, 2: "num_questions not in 1..20", 3: "missing doc_id", 4: "unknown difficulty"}
    hits = spark.createDataFrame([(1, 2, None, "second"), (1, 1, "a.pdf", "first")], "request_id int, rank int, source string, text string")
    prompts = Q.build_prompts(Q.validate_requests(req), hits)
    text = prompts.first()["prompt"]
    assert "[1] (Source: a.pdf)\nfirst\n\n[2] (Source: Unknown Document)\nsecond" in text
    replies = Q.generate(prompts, lambda: lambda p: "x", lambda r: False)
    assert [r["attempt"] for r in replies.collect()] == [1, 2, 3]


def test_scores(spark):
    key = spark.createDataFrame([(k, "A") for k in range(8)], "question_id int, correct string")
    rows = [(1, 0, "B", 1, 1), (1, 0, "A", 2, 2), (1, 1, "A", 1, 3), (1, 2, "A", 5, 9), (1, 2, "C", 5, 10), (2, 3, "A", 1, 4)]
    df = spark.createDataFrame(rows, "session_id int, question_id int, selected string, ts int, event_id int")
    got = {r["session_id"]: (r["answered"], r["score"], r["percent"]) for r in reports.score_sessions(df, key).collect()}
    assert got == {1: (3, 2, 25), 2: (1, 1, 13)}


@pytest.mark.parametrize("answer, want", [("paging works", 1.0), ("unrelated thing", 0.3333)])
def test_grounding(spark, answer, want):
    q = spark.createDataFrame([(1, 1, "Paging", {"A": answer}, "A")], "request_id int, id int, question string, options map<string,string>, correct string")
    c = spark.createDataFrame([(1, "How paging works.")], "request_id int, context string")
    assert Q.grounding_check(q, c).first()["grounding"] == want
