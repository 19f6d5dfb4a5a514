"""Language sets against brute force, and the stage that rejects what no learned language explains."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import langid as L

WORDS = {"aa": ["abra", "alba", "bala", "labra"], "kk": ["kiku", "kuki", "tiku"], "zz": ["zyx", "yzzy", "xyz"]}


def say(rng, k, n):
    return " ".join(rng.choice(WORDS[k], n))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    counts = np.zeros((3, L.CELLS))
    for k, name in enumerate(sorted(WORDS)):
        for c in L.cells(say(rng, name, 3000)):
            counts[k] += np.bincount(c, minlength=L.CELLS)
    return L.Model(sorted(WORDS), counts)


def brute(model, text, penalty=1.0):
    """Every set of languages, proportions by long expectation-maximisation over single trigrams."""
    trigrams = np.concatenate(list(L.cells(text)))
    best = None
    for size in (1, 2, 3):
        for live in combinations(range(3), size):
            like = model.like[trigrams][:, live]
            share = np.full(size, 1 / size)
            for _ in range(300):
                joint = like * share
                share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            fit = np.log(like @ share).sum()
            score = fit - penalty * np.log(len(trigrams)) * (size - 1)
            if best is None or score > best[0]:
                best = (score, {model.langs[k]: s for k, s in zip(live, share)}, fit - len(trigrams) * np.log(1 / L.CELLS))
    return best


def test_sets_equal_brute_force(model):
    rng = np.random.default_rng(7)
    for _ in range(25):
        parts = [say(rng, k, int(n)) for k, n in zip(sorted(WORDS), rng.integers(0, 40, 3)) if n]
        text = " ".join(parts) or "abra"
        _, want, better = brute(model, text)
        got, nats = model.select(text, rounds=300)
        assert dict(got).keys() == want.keys(), text
        assert all(abs(s - want[k]) < 0.02 for k, s in got)
        assert abs(nats - better) < 0.5


def test_what_no_language_explains(model):
    rng = np.random.default_rng(2)
    assert model.recognises(say(rng, "aa", 50)) and model.recognises(say(rng, "aa", 20) + " " + say(rng, "zz", 20))
    assert model.recognises("qj")  # too short to tell
    assert not model.recognises("12 34") and not model.recognises("")
    assert not model.recognises("".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 5000, 200)))


def test_stage_uses_the_model(spark):
    """Texts of letters go where no learned language explains them; words of the languages stay."""
    rng = np.random.default_rng(3)
    rows = [(k, say(rng, name, 60), name) for k, name in enumerate(sorted(WORDS) * 40)]
    rows += [(500 + k, "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 5000, 300)), None) for k in range(5)]
    rows += [(600, None, "aa"), (601, "", "aa"), (602, "123", None), (603, "abra", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    got = corpus_pipeline.known_language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(120), 603]


def test_too_many_labels_are_an_error(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(6)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="max_langs"):
        L.train(docs, max_langs=5)
    assert len(L.train(docs, max_langs=6).langs) == 6
