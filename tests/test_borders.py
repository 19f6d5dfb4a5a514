"""Learned sentence borders: counts by hand, and borders of hand-marked texts in three languages after learning from
other sentences (``|`` marks a border in the sample)."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import borders as B

SCHEMA = "doc_id long, text string, lang string"
#: Sentences to learn from: {a} is an abbreviated word, {n} a name, {w} a plain word.
TEMPLATES = {
    "en": ["The letter came from {a} {n} in the {w}.", "We met {a} {n} and left the {w}.", "She keeps a {w} for the {w}.", "It was the {w}.", "They saw the {w}.", "Nobody knew about the {w}!", "The {w} costs approx. ten coins in the {w}.", "He likes fruit, e.g. the {w}."],
    "de": ["Der Brief kam von {a} {n} aus dem {w}.", "Wir trafen {a} {n} bei dem {w}.", "Sie hat das {w}.", "Es war das {w}.", "Dort steht z.B. das {w}.", "Niemand kannte das {w}!", "Das {w} kostet ca. zehn Taler im {w}."],
    "es": ["La carta era de {a} {n} en la {w}.", "Vimos a {a} {n} cerca de la {w}.", "Ella tiene una {w}.", "Era la {w}.", "Hay fruta, p.ej. la {w}.", "Nadie sabe de la {w}!", "La {w} cuesta aprox. diez monedas en la {w}."],
}
SHORT = {"en": ["Dr.", "Mr.", "Prof.", "St."], "de": ["Dr.", "Hr.", "Prof.", "Fr."], "es": ["Sr.", "Dra.", "Ud.", "Prof."]}
NAMES = ["Alba", "Moreno", "Keller", "Lind", "Okoro", "Petit", "Rossi", "Sato", "Tamm", "Vega"]
WORDS = {
    "en": ["garden", "window", "river", "table", "market", "bridge", "letter", "house"],
    "de": ["Fenster", "Haus", "Buch", "Dorf", "Feld", "Schiff", "Werk", "Ufer"],
    "es": ["casa", "mesa", "calle", "puerta", "plaza", "carta", "torre", "playa"],
}
MARKED = {
    "en": "Mr. Weber met Dr. Haug in the garden.|They spoke about St. Gallen for hours.|Was it late?|It was 3.5 miles away.|Prof. Ames likes fruit, e.g. the pear.|We saw approx. ten ships.|"
    "He asked J. K. Lowe about it.|She said \"go home.\"|They left... and came back.|The house was empty.|We like St. Paul.|It is old.|He knows the Dr.|They do not.",
    "de": "Hr. Weber traf Dr. Haug bei dem Haus.|Es war spät.|Dort lag z.B. das Buch.|Das Werk kostet ca. drei Taler.|Wir sahen Prof. Ames.|Sie kam von Fr. Lowe aus dem Dorf.|Niemand sah das Schiff!|Der Brief war alt.|Er kannte den Hr.|Das war gut.",
    "es": "El Sr. Weber vio la plaza.|Era tarde.|La Dra. Haug tiene una mesa.|Hay fruta, p.ej. la pera.|La torre cuesta aprox. mil monedas.|Nadie vio a Ud. Lowe.|Ella tiene una casa!|Vimos la calle.",
}


def corpus(n=400):
    rng = random.Random(2)
    rows = []
    for lang, templates in TEMPLATES.items():
        for _ in range(n):
            said = []
            for t in rng.choices(templates, k=12):
                while "{w}" in t:
                    t = t.replace("{w}", rng.choice(WORDS[lang]), 1)
                said.append(t.replace("{a}", rng.choice(SHORT[lang])).replace("{n}", rng.choice(NAMES)))
            rows.append((len(rows), " ".join(said), lang))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    return B.learn(spark.createDataFrame(corpus(), SCHEMA))


def test_counts_by_hand(spark):
    text = 'A cat. The (cat) saw 12 e.g. mice! "Run..." said\nthe cat.'
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, None, "en"), (3, "", None), (4, " \n", "x")], SCHEMA)
    got = {(r["lang"], r["before"], r["word"]): (r["n"], r["stop"], r["small"], r["capital"]) for r in B.word_counts(df).collect()}
    assert got == {("en", b, w): tuple(2 * x for x in c) for (b, w), c in {
        ("!", "a"): (1, 0, 0, 1), ("", "cat"): (3, 2, 3, 0), ("cat.", "the"): (1, 0, 0, 1), ("", "saw"): (1, 0, 1, 0), ("", "##"): (1, 0, 0, 0), ("", "e.g"): (1, 1, 1, 0),
        ("e.g.", "mice"): (1, 0, 1, 0), ("!", "run"): (1, 0, 0, 1), ("!", "said"): (1, 0, 1, 0), ("", "the"): (1, 0, 1, 0),
    }.items()}


def test_learned_words(learned):
    assert {f"{lang}:{a.lower().rstrip('.')}" for lang, own in SHORT.items() for a in own} | {"en:approx", "en:e.g", "de:z.b", "de:ca", "es:p.ej", "es:aprox"} == set(learned.short)
    assert {"en:the", "en:they", "de:wir", "es:era"} <= learned.start
    assert not {f"{lang}:{n.lower()}" for lang in SHORT for n in NAMES} & learned.start


def test_marked_borders_are_found(spark, learned):
    """Precision and recall over all borders inside the marked texts; the fixed list is measured beside."""
    df = spark.createDataFrame([(n, t.replace("|", " "), lang) for n, (lang, t) in enumerate(MARKED.items())], SCHEMA)
    found = df.select("lang", learned.split(F.col("text"), F.col("lang")).alias("own"), T.split_sentences(F.col("text")).alias("fixed")).collect()
    hits = Counter()
    for r in found:
        def ends(sentences):
            out, at = set(), 0
            for s in sentences:
                at += len("".join(s.split()))
                out.add(at)
            return out - {at}

        want = ends(MARKED[r["lang"]].split("|"))
        for name in ("own", "fixed"):
            got = ends(r[name])
            hits[name, "right"] += len(got & want)
            hits[name, "wrong"] += len(got - want)
            hits[name, "missed"] += len(want - got)
    precision = lambda n: hits[n, "right"] / (hits[n, "right"] + hits[n, "wrong"])
    recall = lambda n: hits[n, "right"] / (hits[n, "right"] + hits[n, "missed"])
    print({n: (round(precision(n), 3), round(recall(n), 3)) for n in ("own", "fixed")})
    assert precision("own") >= 0.95 and recall("own") >= 0.95
    assert precision("own") > precision("fixed")


def test_nothing_is_lost_and_edges(spark, learned):
    texts = [None, "", "  ", "one", "A. B. C.", "x. y", "Dr.", "Dr. ", '"Mr. Sato." The end', "word " * 3000 + "end. The next", "¡Sí. No", ". . .", "...\n\n!? a"]
    df = spark.createDataFrame([(n, t, lang) for n, t in enumerate(texts) for lang in ("en", None, "xx")], SCHEMA)
    for r in df.select("text", learned.split(F.col("text"), F.col("lang")).alias("s")).collect():
        if r["text"] is None:
            assert r["s"] is None
        else:
            assert "".join("".join(r["s"]).split()) == "".join(r["text"].split())
            assert all(s and s == s.strip() for s in r["s"])


def test_an_empty_table_learns_nothing(spark):
    model = B.learn(spark.createDataFrame([], SCHEMA))
    assert model == B.Borders(frozenset(), frozenset())
    row = spark.createDataFrame([(1, "It rains. We go.", "en")], SCHEMA).select(model.split(F.col("text"), F.col("lang")).alias("s")).first()
    assert row["s"] == ["It rains.", "We go."]


def test_scores_do_not_depend_on_the_amount_of_text(spark, monkeypatch):
    monkeypatch.setattr(B, "CORPUS", 5000)
    rows = corpus(120)
    once, thrice = (B.learn(spark.createDataFrame(rows * k, SCHEMA)) for k in (1, 3))
    assert once.short == thrice.short


def test_semantic_split_by_learned_sentences(spark, learned):
    from leafmill.operators.semantic import semantic_split

    text = " ".join(MARKED["en"].split("|"))
    sections = spark.createDataFrame([("s", 0, text, 0, len(text))], "source string, section_seq int, text string, start_off long, end_off long")
    parts = semantic_split(sections, max_size=100, split=lambda t: learned.split(t, F.lit("en"))).orderBy("part").collect()
    assert " ".join(p["text"] for p in parts).split() == text.split() and len(parts) > 1
