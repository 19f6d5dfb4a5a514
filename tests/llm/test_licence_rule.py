"""The decision rule: the most probable class alone, then the cover of its templates."""

import numpy as np

from leafmill.llm import license_scan as S

LINES = ["All rights reserved.", "all rights reserved by the general public", "Licensed under CC BY 4.0.", "This work is licensed", "nothing at all", "Released under the MIT License."]


def by_hand(model, text, least, cover):
    tokens = S.words(text)
    grams = {*tokens, *map(" ".join, zip(tokens, tokens[1:]))}
    known = [k for g, k in model.index.items() if g in grams]
    if len(known) < 2:
        return None
    s = (sum(model.w[k] for k in known) + model.w[len(model.index)]) / model.temperature
    p = np.exp(s) / np.exp(s).sum()
    best = int(np.argmax(p))
    if model.families[best] == S.UNKNOWN or p[best] < least:
        return None
    share = max(sum(g in grams for g in t) / len(t) for f, t in model.templates if f == best)
    return model.families[best] if share >= cover else None


def test_rule_by_hand():
    model = S.Classifier().fit(["plain words", "the public was there"])
    texts = LINES + [t for ts in S.TEMPLATES.values() for t in ts]
    for least in (0.3, 0.9, 0.99):
        for t in texts:
            assert (model.classify(t, least, 0.8) or [None])[0] == by_hand(model, t, least, 0.8), t


def test_cover_alone_is_not_enough():
    """A line that holds a whole template, which the classifier takes for no licence, or for another family."""
    text = S.TEMPLATES["mit"][0]
    model = S.Classifier().fit([])
    assert model.classify(text, 0.9, 0.8)[0] == "mit"
    rows = model.features(S.words(text))
    for other in (S.UNKNOWN, "gpl"):
        model.w[rows, model.families.index(other)] += 50.0
        assert model.classify(text, 0.5, 0.8) is None
        model.w[rows, model.families.index(other)] -= 50.0


def test_own_templates(spark):
    own = {"house": ("Use of this page is governed by the rules of the house.",), "free": ("Take it and do as you please with it.",)}
    docs = spark.createDataFrame([(1, "Use of this page is governed by the rules of the house."), (2, "Released under the MIT License."), (3, "words " * 4000)], "doc_id long, text string")
    model = S.train(docs, templates=own)
    assert model.families == ["house", "free", "unknown"]
    got = {r["doc_id"]: [f["family"] for f in r["found"]] for r in S.find_licences(docs, model).collect()}
    assert got == {1: ["house"], 2: [], 3: []}


def test_negatives_read_whole_lines(spark):
    """A licence word far behind in a long line, or on a late line, keeps the line from being a negative."""
    far = "word " * 5000 + S.TEMPLATES["mit"][2]
    late = "x\n" * 80 + S.TEMPLATES["bsd"][0]
    plain = S.train(spark.createDataFrame([(1, "plain")], "doc_id long, text string")).w
    same = S.train(spark.createDataFrame([(1, "plain"), (2, far), (3, late)], "doc_id long, text string")).w
    assert np.array_equal(plain, same)
