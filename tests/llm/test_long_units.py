"""Texts without spaces: units by themselves and in batches give one segmentation."""

import time

import numpy as np
import pytest

from leafmill.llm import sentencepiece_aho as A


def test_one_by_one_equals_batches(monkeypatch, rng):
    a = A.load_automaton()
    units = [A.MARK + "".join(rng.choice(["the", "ing", "é", "日", "\n", "x", "😀", A.OWN_MARK, "0", "tion"]) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    alone = [a.segment_long(u).tolist() for u in units]
    monkeypatch.setattr(A, "FEW", 0)
    ids, size = a.segment(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == alone


def test_a_word_of_any_length():
    e = A.Encoder(A.load_automaton())
    text = "internationalisation" * 10_000
    began = time.time()
    ids = e.encode([text])[0]
    assert e.decode(ids) == text and time.time() - began < 20


def test_names_of_results_are_not_kept(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_tokens int")
    with pytest.raises(ValueError, match="name of a result"):
        A.encode_report(docs, keep=("doc_id", "n_tokens"))
    assert A.encode_report(docs).columns == ["doc_id", "n_tokens", "n_bytes", "round_trip", "ids"]
