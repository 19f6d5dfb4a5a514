"""Calibration of the licence classifier on rows that it was not trained on."""

import numpy as np

from leafmill.llm import license_scan as S


def test_held_rows_do_not_train(monkeypatch):
    """Other n-grams in the held-out rows leave the weights as they are."""
    rows, labels = S.Classifier()._examples(["plain words", "no use here"])
    held = S.Classifier.held_rows(labels)
    assert all(held[labels == k].any() and not held[labels == k].all() for k in np.unique(labels))
    plain = S.Classifier().fit([]).w
    given = S.Classifier._examples

    def other(self, negatives):
        rows, labels = given(self, negatives)
        held = S.Classifier.held_rows(labels)
        return [[0, 1, 2] if h else r for r, h in zip(rows, held, strict=True)], labels

    monkeypatch.setattr(S.Classifier, "_examples", other)
    assert np.array_equal(S.Classifier().fit([]).w, plain)


def test_probability_itself_is_compared():
    """Two families of equal score: neither has the probability ``least``."""
    model = S.Classifier()
    text = S.TEMPLATES["mit"][0]
    rows = model.features(S.words(text))
    for family in ("mit", "gpl"):
        model.w[rows, model.families.index(family)] = 2.0
    assert model.classify(text, 0.9, 0.8) is None
    assert model.classify(text, 0.4, 0.8)[0] == "mit"
