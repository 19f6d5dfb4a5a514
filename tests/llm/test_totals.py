"""Work that grows as the number of matches, spans or turns, not as its square."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat_format, pii
from leafmill.llm import secret_scan as S
from leafmill.llm import totals as R


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 4095, 4096, 4097, 9000])
def test_totals_before(spark, rng, n):
    sizes = [rng.randint(0, 9) for _ in range(n)]
    got = spark.createDataFrame([(sizes,)], "a array<long>").select(R.totals_before(F.col("a")).alias("t")).first()["t"]
    assert got == [sum(sizes[:i]) for i in range(n)] if n < 5000 else got == [0, *np.cumsum(sizes)[:-1].tolist()]


def test_null_array(spark):
    assert spark.createDataFrame([(None,)], "a array<long>").select(R.totals_before(F.col("a")).alias("t")).first()["t"] is None


def test_a_hundred_thousand_secrets_in_one_text(spark):
    text = "é".join(f"{k:024x}" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "token=abcdef")], "doc_id long, text string").repartition(1)
    S.secret_report(docs.where("doc_id = 2")).collect()
    began = time.time()
    rows = {r["doc_id"]: r for r in S.secret_report(docs).collect()}
    assert time.time() - began < 60
    assert rows[1]["n_hex"] == 100_000 and rows[1]["spans"].endswith(f"hex:{25 * 99_999}:{25 * 99_999 + 24}") and rows[2]["n_assign"] == 1


def test_one_pair_of_many_turns(spark):
    said = spark.range(20_000).selectExpr("1L AS conv_id", "CAST(id AS INT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "CAST(id AS STRING) AS text")
    row = chat_format.assemble(chat_format.preference_turns(said)).first()
    for side in ("chosen", "rejected"):
        assert all(row[side][a:b].startswith("<|assistant|>\n") and row[side][a:b].endswith("<|end|>\n") for a, b in row[f"{side}_loss"])
        assert sum(b - a for a, b in row[f"{side}_loss"]) == sum(len(x) + 7 + 1 for x in row[side].split("<|end|>\n") if x.startswith("<|assistant|>"))


def test_added_spans_keep_clear_of_known_ones(rng):
    for _ in range(300):
        text = "x" * 200
        known = sorted((a, rng.randint(0, 3), a + rng.randint(1, 40)) for a in (rng.randint(0, 150) for _ in range(rng.randint(0, 5))))
        places = [(a, a + 3) for a in range(0, 197, 4)]
        labels = np.array([rng.choice([0, 0, 1]) for _ in places])
        got = pii.model_spans(text, [places], [(labels, np.ones(len(places)))], known, 0.9)
        want = [(a, b) for (a, b), m in zip(places, labels) if m and not any(c < b and d > a for c, _, d in known)]
        assert [(a, b) for a, _, b in got] == want
