import unicodedata
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import cleaning, pages

PAGE = "source string, page int, page_content string"


# A model of the cleaning rules, character by character and line by line.


def rejoined(text):
    """A word broken by a hyphen at a line's end goes on with its next letter; that letter breaks no further word."""
    out, i = [], 0
    while i < len(text):
        out.append(text[i])
        k = i + 2
        if (text[i].isalnum() or text[i] == "_") and text[i + 1 : k] == "-":
            while k < len(text) and text[k].isspace():
                k += 1
            if "\n" in text[i + 2 : k] and text[k : k + 1] and "a" <= text[k] <= "z":
                out.append(text[k])
                i = k
        i += 1
    return "".join(out)


def few_digits(s):
    return 1 <= len(s) <= 4 and all(unicodedata.category(c) == "Nd" for c in s)


def says_page_number(line):
    low = line.strip().lower()
    for word in ("page", "p."):
        if low.startswith(word) and few_digits(low[len(word) :].strip()):
            return True
    before, of, after = low.partition("of")
    if of and few_digits(before.strip()) and few_digits(after.strip()):
        return True
    while low and (low[0].isspace() or low[0] in "-–—."):
        low = low[1:]
    while low and (low[-1].isspace() or low[-1] in "-–—."):
        low = low[:-1]
    return few_digits(low)


def shortened(text, mark, most):
    return "".join(c * (min(n, most) if c == mark else n) for c, n in ((c, len(list(g))) for c, g in groupby(text)))


def model(text):
    text = "".join(c for c in rejoined(text) if ord(c) >= 32 or c in "\t\n\r")
    rows = [x for x in text.split("\n") if not says_page_number(x)]
    text = "\n".join(x.rstrip(" \t") for x in rows)
    return shortened(shortened(text, "\n", 2), " ", 1).strip()


WORDS = ["word", "ré", "-", "\n", " ", "  ", "\t", "\x07", "12", "12345", "Page 3", "Page42", "page 12345", "p. 4", "p.4", "p4", "3 of 9", "3of10", "3 of", "– 5 –", ".", "A", "b", "_", "\xa0", "٣", "of", "page"]
CASES = []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25))
def test_collect_cases(parts):
    CASES.append("".join(parts))


def test_clean_text_equals_model(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*CASES, *WORDS])], "k int, t string")
    for r in df.select("t", T.clean_text(F.col("t")).alias("c")).collect():
        assert r["c"] == model(r["t"]), r["t"]


def test_page_number_lines(spark):
    gone = ["7", "- 42 -", "..9..", "Page42", "page  7", "P. 12", "p.12", "3of10", "3 of 10", " — 1234 — ", "\t8\r"]
    stay = ["page 12345", "12345", "p 4", "page", "3 of", "of 4", "Chapter 3", "page 4 5", "1 2", "3 of 12345", ""]
    df = spark.createDataFrame([(x,) for x in gone + stay], "t string")
    got = [r["x"] for r in df.select(T.strip_page_numbers(F.concat(F.lit("a\n"), "t", F.lit("\nb"))).alias("x")).collect()]
    assert got == ["a\nb"] * len(gone) + [f"a\n{x}\nb" for x in stay]


def test_sentences(spark):
    from leafmill.operators.guardrails import sentences

    cases = {
        "Dr. Smith went home. He slept.": ["Dr. Smith went home.", "He slept."],
        "It rose by 3.5 points. Then it fell.": ["It rose by 3.5 points.", "Then it fell."],
        "As shown by Jones et al. (2020) and e.g. Prof. St. John.  Good!": ["As shown by Jones et al. (2020) and e.g. Prof. St. John.", "Good!"],
        "wait... what? Yes.\nNo": ["wait... what?", "Yes.", "No"],
        'He said "stop." She did. "Why?" he asked. J. K. Rowling wrote.': ['He said "stop."', "She did.", '"Why?"', "he asked.", "J. K. Rowling wrote."],
        "": [], "   ": [], "one": ["one"], "Was it I. Then who": ["Was it I.", "Then who"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", T.split_sentences(F.col("t")).alias("s")).collect():
        assert r["s"] == cases[r["t"]] == sentences(r["t"]), r["t"]


SENTENCE_PARTS = []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Dr.", "al.", "e.g.", "A.", "I.", "x.", "B", "c", "3.5", "?", "!", '."', ".)", ".", "...", " ", "  ", "\n", "é", "É", "_."]), max_size=14))
def test_collect_sentences(parts):
    SENTENCE_PARTS.append("".join(parts))


def test_both_splitters_agree(spark):
    from leafmill.operators.guardrails import sentences

    df = spark.createDataFrame([(t,) for t in SENTENCE_PARTS], "t string")
    for r in df.select("t", T.split_sentences(F.col("t")).alias("s")).collect():
        assert r["s"] == sentences(r["t"]), r["t"]
        assert "".join("".join(r["s"]).split()) == "".join(r["t"].split())


def test_isolated_lines(spark):
    t = "Figure 2.1\nFigure 2.1 shows\nTable 3\n● a – b\n[1] Author, Title\n[2] More\n## Next\nmore [1] Text\n[1] Other\nlast\n# End"
    row = spark.createDataFrame([(t,)], "t string").select(
        T.strip_isolated_captions(F.col("t")).alias("c"), T.ascii_fold_symbols(F.col("t")).alias("s"), T.drop_references(F.col("t")).alias("r")).first()
    assert row["c"].startswith("Figure 2.1 shows\n●") and "* a - b" in row["s"]
    assert row["r"].split("\n") == ["Figure 2.1", "Figure 2.1 shows", "Table 3", "● a – b", "## Next", "more [1] Text", "# End"]


def test_repeating_lines(spark):
    rows = [("a", k, f"Running Head\nbody {k} text\nmore {k}\n\nfoot") for k in range(4)] + [("b", 0, "Running Head\nx")]
    df = spark.createDataFrame([*rows, ("c", 0, None)], PAGE)
    got = {(r["source"], r["line"], r["n"]) for r in cleaning.detect_repeating_lines(df).collect()}
    assert got == {("a", "running head", 4), ("a", "foot", 4)}
    cleaned = {(r["source"], r["page"]): r["page_content"] for r in cleaning.clean_pages(df).collect()}
    assert cleaned["a", 1] == "body 1 text\nmore 1" and cleaned["b", 0].startswith("Running") and ("c", 0) not in cleaned
    three = spark.createDataFrame([("s", k, f"line {k}") for k in range(3)], PAGE)
    assert cleaning.detect_repeating_lines(three).count() == 3  # int(3 * 0.5) is 1
    assert cleaning.detect_repeating_lines(three, min_occurrences_floor=2).count() == 0


def test_gate(spark):
    good = " ".join(["word"] * 40)
    rows = [(0, good), (1, " ".join(["word"] * 39)), (2, " \n "), (3, None), (4, " ".join(["12345678"] * 40 + ["a"]))]
    got = {r["page"]: r["gate_reason"] for r in pages.quality_gate(spark.createDataFrame(rows, "page int, page_content string")).collect()}
    assert got == {0: "ok", 1: "low_quality", 2: "empty", 3: "empty", 4: "low_quality"}


def test_tables_and_blocks(spark):
    row = spark.sql("SELECT array(array(array('h1', NULL), array('a', 'b')), array()) AS t")
    assert row.select(T.render_markdown_tables(F.col("t")).alias("m")).first()["m"] == "| h1 |  |\n| --- | --- |\n| a | b |\n"
    blocks = [("s", 0, 0, 10.0, 0.0, "second"), ("s", 0, 1, 9.0, 5.0, "also second"), ("s", 0, 2, 30.0, 0.0, "third"), ("s", 0, 3, 0.0, 9.0, " "), ("s", 0, 4, 1.0, 0.0, "tied")]
    df = spark.createDataFrame(blocks, "source string, page_num int, seq int, y0 double, x0 double, text string")
    # 10/20 rounds to 0 and 30/20 to 2 (half to even).
    assert pages.order_blocks(df).first()["text"] == "second\ntied\nalso second\nthird"


def test_unicode_categories_used_by_the_gate():
    assert unicodedata.category("é").startswith("L")
