"""Scores folded in batch by batch, pages of damaged files, headers of any number."""

import os
import random

from pyspark.sql import functions as F

from leafmill.operators import cleaning
from leafmill.operators.reports import score_sessions
from leafmill.session import shared_dir
from leafmill.sources import pages as P
from leafmill.sources import store as S
from leafmill.streaming import ingest

ANSWER = "session_id string, question_id int, selected string, ts long, event_id long"
PAGE = "source string, page int, page_content string"


def key(spark):
    return spark.createDataFrame([(q, "ABCD"[q % 4]) for q in range(6)], "question_id int, correct string")


def batches(rng, n):
    return [[(rng.choice([None, *"stuvwxyz"]), rng.choice([None, *range(8)]), rng.choice([None, *"ABCD"]), rng.randint(0, 40), 1000 * b + k) for k in range(rng.randint(1, 40))] for b in range(n)]


def scores(df):
    return sorted((tuple(r) for r in df.select("session_id", "answered", "score", "total", "percent").collect()), key=str)


def test_batches_in_any_order_and_again(spark, tmp_path):
    rng = random.Random(8)
    parts = batches(rng, 4)
    want = scores(score_sessions(spark.createDataFrame([r for b in parts for r in b], ANSWER), key(spark)))
    for name, order in (("a", [0, 1, 2, 3]), ("b", [3, 1, 1, 0, 2, 3])):
        path = str(tmp_path / name)
        for n in order:
            ingest.fold_answers(spark.createDataFrame(parts[n], ANSWER), key(spark), path)
        assert scores(ingest.read_scores(spark, path)) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    path = str(tmp_path / "scores")
    ingest.fold_answers(spark.createDataFrame([(f"s{k}", k % 6, "A", k, k) for k in range(400)], ANSWER), key(spark), path)
    before = {store: S._state(spark, f"{path}/{store}").folders for store in ("answers", "scores")}
    ingest.fold_answers(spark.createDataFrame([("s7", 2, "C", 900, 900)], ANSWER), key(spark), path)
    for store in ("answers", "scores"):
        after = S._state(spark, f"{path}/{store}").folders
        assert len(before[store]) > 8 and sum(after[b] != f for b, f in before[store].items()) == 1
    assert [tuple(r) for r in ingest.read_scores(spark, path).where("session_id = 's7'").collect()] == [("s7", 2, 1, 6, 17)]


def test_stream_of_batches_leaves_no_scratch(spark, tmp_path):
    parts = batches(random.Random(9), 3)
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, ANSWER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    stream = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.score_stream(stream, key(spark), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == held
    assert scores(ingest.read_scores(spark, str(tmp_path / "out"))) == scores(score_sessions(spark.createDataFrame([r for b in parts for r in b], ANSWER), key(spark)))


def test_bad_files_are_set_aside(spark):
    def parser(path, content):
        if content == b"":
            return []
        if content == b"odd":
            return [{"page": "first", "page_content": "x"}]
        return [{"page": 0, "page_content": content.decode()}]

    files = [("d/a", b"one"), ("d/b", b"\xff"), ("d/c", b""), ("d/e", b"odd"), ("d/f", None)]
    pages, bad, counts = P.parsed_files(spark.createDataFrame(files, "path string, content binary"), parser)
    assert [(r["source"], r["page_content"]) for r in pages.collect()] == [("a", "one")]
    assert {r["file_path"]: r["error"].split(":")[0] for r in bad.collect()} == {"d/b": "UnicodeDecodeError", "d/e": "ValueError", "d/f": "AttributeError"}
    assert counts == {"files": 5, "pages": 1, "failed": 3}


def test_headers_sent_or_joined(spark):
    rng = random.Random(5)
    lines = ["Head ", "  foot", "body", "", "Other", "ÄRGER", "x\ty"]
    rows = [(rng.choice(["a", "b", None]), k, None if k == 3 else "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(300)]
    pages = spark.createDataFrame([*rows, rows[0], rows[0]], PAGE).withColumn("line", F.lit("mine"))
    heads = [("a", "head"), ("a", "foot"), ("a", "head"), ("b", "ärger"), (None, "other"), ("b", None), (None, "x\ty")]
    for scope in ("source", "all"):
        def left(source, text, scope=scope):
            known = {h for s, h in heads if scope == "all" or s == source}
            return None if text is None else "\n".join(x for x in text.split("\n") if x.strip().lower() not in known)

        want = sorted(((s, k, left(s, t)) for s, k, t in [*rows, rows[0], rows[0]]), key=str)
        for sent in (1 << 20, 0):
            got = cleaning.strip_known_headers(pages, spark.createDataFrame(heads, "source string, line string"), scope, sent)
            assert got.columns == pages.columns
            assert sorted(((r["source"], r["page"], r["page_content"]) for r in got.collect()), key=str) == want
