import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import guardrails as G
from leafmill.operators import sections, semantic

PAGE = "source string, page int, page_content string"


def fold(texts, low, high):
    return [p[0] for p in G.apply_size_guardrails([(t, 0, 0, (None, None, None)) for t in texts], low, high)]


def test_headers_make_sections(spark):
    """A heading opens a chunk of its own, which carries the path of its headings and knows its pages."""
    text = "# Rivers\nWater runs downhill.\n## Banks\nBanks wear away in floods.\n### Mud\nMud settles."
    pages = spark.createDataFrame([("rivers.txt", 4, text), ("rivers.txt", 5, "And so on.")], PAGE)
    got = G.chunk_documents(pages, min_size=10, max_size=1000).orderBy("chunk_index").collect()
    assert [(r["section"], r["subsection"], r["subsubsection"]) for r in got] == [("Rivers", None, None), ("Rivers", "Banks", None), ("Rivers", "Banks", "Mud")]
    assert [r["text"].split("\n")[0] for r in got] == ["Rivers", "Rivers > Banks", "Rivers > Banks > Mud"]
    assert [(r["page_start"], r["page_end"]) for r in got] == [(4, 4), (4, 4), (4, 5)]
    assert "And so on." in got[2]["text"]


def test_headings_in_fences_and_clearing(spark):
    text = "intro\n# A\n## B\n### C\nx\n```\n# no heading\n```\n## D\ny\n# E\nz"
    got = sections.split_by_headers(spark.createDataFrame([("s", 0, text)], PAGE)).orderBy("section_seq").collect()
    assert [(r["section"], r["subsection"], r["subsubsection"]) for r in got] == [
        (None, None, None), ("A", None, None), ("A", "B", None), ("A", "B", "C"), ("A", "D", None), ("E", None, None)]
    assert "# no heading" in got[3]["text"]


def sections_of(pages):
    """Sections of one source's pages (page, text): one walk over its whole text."""
    whole, out, path, fenced, off = [], [], [None] * 3, False, 0
    for _, text in sorted(pages, key=lambda p: (p[0], p[1] or "")):
        whole += [*(text or "").split("\n"), ""]
    held = [path[:], [], 0]
    for line in whole:
        mark = line.split(" ")[0]
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced and mark in ("#", "##", "###"):
            out.append(held)
            name = line[len(mark) :].strip()
            path = [*path[: len(mark) - 1], name, None, None][:3]
            held = [path[:], [], off]
        held[1].append(line)
        off += len(line) + 1
    out.append(held)
    return [(k, *p, "\n".join(rows).strip(), at) for k, (p, rows, at) in enumerate(out) if "\n".join(rows).strip()]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_sections_equal_one_walk(spark, monkeypatch, block):
    """Page numbers that repeat, fences over pages, a null source, and blocks of any size."""
    monkeypatch.setattr(sections, "BLOCK_PAGES", block)
    rng = random.Random(block)
    lines = ["# One", "# Two", "## In", "## Out", "### Deep", "```", "text", "more", "", "#no", "#### four"]
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 0, 1, 2, 3, 7, 9]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for _ in range(40)] + [("a", 2, None)]
    got = {}
    df = spark.createDataFrame(rows, PAGE).repartition(3)
    for r in sections.split_by_headers(df).collect():
        got.setdefault(r["source"], []).append((r["section_seq"], r["section"], r["subsection"], r["subsubsection"], r["text"], r["start_off"]))
    for source in ("a", "b", None):
        want = sections_of([(p, t) for s, p, t in rows if s == source])
        assert sorted(got[source]) == sorted(want, key=lambda x: x[0]), source
    parts = sections.concat_pages(df, part_chars=20).collect()
    for source in ("a", "b", None):
        text = "".join(r["text"] for r in sorted((r for r in parts if r["source"] == source), key=lambda r: r["part"]))
        assert text == "".join(f"{t or ''}\n\n" for _, t in sorted(((p, t) for s, p, t in rows if s == source), key=lambda p: (p[0], p[1] or "")))


def test_equal_page_numbers_do_not_interleave(spark):
    df = spark.createDataFrame([("s", 0, "a1\na2\na3"), ("s", 0, "b1\nb2\nb3")], PAGE)
    assert sections.split_by_headers(df).first()["text"].split() == ["a1", "a2", "a3", "b1", "b2", "b3"]


def test_similarity_breaks(spark):
    """Four unit vectors, two and two alike: the one low neighbour similarity breaks them, if the factor lets it."""
    a, b = (0.8, 0.6), (-0.6, 0.8)
    rows = [(0, k, f"s{k}.", list(v)) for k, v in enumerate([a, (0.78, 0.6257795138864806), b, (-0.62, 0.7846018098373213)])]
    df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string, embedding array<double>")
    assert [r["text"] for r in semantic.split_vectors(df, ["doc_id"], 0.5).orderBy("part").collect()] == ["s0. s1.", "s2. s3."]
    assert semantic.split_vectors(df, ["doc_id"], 1.5).count() == 1


def test_guardrail_cases():
    assert fold(["Ice melts.", "Snow melts too."], 40, 90) == ["Ice melts. Snow melts too."]
    got = fold(["Rain falls on the hills. " * 9], 40, 90)
    assert len(got) > 1 and all(len(x) <= 90 for x in got)
    assert fold(["x" * 300], 10, 100) == ["x" * 300]
    assert fold([], 10, 100) == []
    assert fold(["a" * 60, "b" * 70, "c"], 50, 100) == ["a" * 60, "b" * 70 + " c"]


def by_definition(pieces, low, high):
    """(chunks, rest): the first chunk is the shortest run of pieces that is long enough, or that the next piece does
    not fit behind; what follows is cut in the same way. What no chunk takes is the rest."""
    size = lambda n: sum(map(len, pieces[:n])) + n - 1
    for n in range(1, len(pieces) + 1):
        if size(n) >= low or (n < len(pieces) and size(n + 1) > high):
            chunks, rest = by_definition(pieces[n:], low, high)
            return [" ".join(pieces[:n]), *chunks], rest
    return [], pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab. ", min_size=1, max_size=40), max_size=12), st.integers(1, 40), st.integers(10, 80))
def test_merge_equals_definition(pieces, low, high):
    want, rest = by_definition(pieces, low, high)
    if rest:
        tail = " ".join(rest)
        want = [*want[:-1], f"{want[-1]} {tail}"] if want and len(want[-1]) + 1 + len(tail) <= high else [*want, tail]
    assert [p[0] for p in G.merge_undersized([(c, 0, 0, ()) for c in pieces], low, high)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc.! ", min_size=1, max_size=80), max_size=8))
def test_guardrails_lose_no_word(chunks):
    assert " ".join(fold(chunks, 20, 50)).split() == " ".join(chunks).split()


@pytest.mark.parametrize("block", [3, 1024])
def test_runs_equal_one_fold(spark, monkeypatch, block):
    """Sources cut into runs give the chunks of one fold over each source."""
    monkeypatch.setattr(sections, "BLOCK_PAGES", block)
    rng = random.Random(block)
    rows, texts = [], {}
    for source in ("a", "b", "c", "short", None):
        for k in range({"short": 7, "c": 1}.get(source, 60)):
            text = " ".join(rng.choice(["word", "two.", "longer", "end!"]) for _ in range(rng.choice([1, 1, 2, 12] if source != "short" else [1])))
            texts.setdefault(source, []).append(text)
            rows.append((source, k // 4, k % 4, text, k, k + 1, f"h{k}", None, None))
    df = spark.createDataFrame(rows, "source string, section_seq long, part int, text string, start_off long, end_off long, section string, subsection string, subsubsection string")
    got = {}
    for r in G.fold_chunks(df.repartition(5), 20, 60).collect():
        got.setdefault(r["source"], []).append((r["chunk_index"], r["text"]))
    for source, own in texts.items():
        assert sorted(got[source]) == list(enumerate(fold(own, 20, 60)))
    index = {(r["source"], r["chunk_index"]): r["section"] for r in G.fold_chunks(df, 20, 60, compat_index_meta=True).collect()}
    assert index == {(s, k): f"h{min(k, len(texts[s]) - 1)}" for s in texts for k in range(len(got[s]))}


def test_breadcrumb_and_ids(spark):
    row = spark.range(1).select(
        T.build_breadcrumb(F.lit("Seas"), F.lit("Tides"), F.lit(None)).alias("a"), T.build_breadcrumb(F.lit(None), F.lit(""), F.lit(None)).alias("b"),
        T.chunk_id(F.lit("seas.txt"), F.lit(0)).alias("c"), T.chunk_id(F.lit("seas.txt"), F.lit(0)).alias("d"), T.chunk_id(F.lit("seas.txt"), F.lit(1)).alias("e"),
    ).first()
    assert (row["a"], row["b"]) == ("Seas > Tides", "") and len(row["c"]) == 64 and row["c"] == row["d"] != row["e"]


def test_chunks_do_not_depend_on_partitions(spark):
    random.seed(5)
    rows = [(f"s{k % 3}", k // 3, " ".join(random.choice(["# H\n", "word.", "two words.", "\n"]) for _ in range(60))) for k in range(12)]
    df = spark.createDataFrame(rows, PAGE)
    a = G.chunk_documents(df.repartition(1), max_size=200).collect()
    b = G.chunk_documents(df.repartition(7), max_size=200).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len({r["chunk_id"] for r in a}) == len(a)


def test_compat_metadata_and_empty(spark):
    pages = spark.createDataFrame([("s", 0, "# A\n" + "x" * 50 + "\n# B\n" + "y" * 50 + "\n# C\n" + "z" * 200)], PAGE)
    names = lambda **k: [r["section"] for r in G.chunk_documents(pages, min_size=100, **k).orderBy("chunk_index").collect()]
    assert names() == ["A", "C"] and names(compat_index_meta=True) == ["A", "B"]
    assert G.chunk_documents(spark.createDataFrame([], PAGE)).count() == 0


def test_token_split():
    text = "a b c d. e f g h.\n\ni j k l m n"
    got = G.recursive_token_split(text, 4, 0)
    assert all(len(p.split()) <= 4 for p in got) and " ".join(got).replace(".", "").split() == text.replace(".", "").split()
    again = G.recursive_token_split(text, 4, 2)
    assert again[1].split()[:2] == got[0].split()[-2:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", ". ", "\n", "\n\n", " ", "long" * 9]), max_size=80), st.integers(2, 12), st.integers(0, 6), st.booleans())
def test_token_split_keeps_its_limit(parts, most, overlap, by_chars):
    """The overlap counts to the limit, whatever counts tokens, and nothing but white space and marks is lost."""
    count = len if by_chars else lambda s: len(s.split())
    text = "".join(parts)
    got = G.recursive_token_split(text, most, overlap, count)
    assert all(count(p) <= most for p in got)
    assert bool(got) == bool(text.strip())
    plain = G.recursive_token_split(text, most, 0, count)
    assert "".join("".join(plain).replace(".", "").split()) == "".join(text.replace(".", "").split())


def test_three_thousand_words():
    got = G.recursive_token_split(" ".join(f"w{k}" for k in range(3000)))
    assert max(len(p.split()) for p in got) == 512 and all(p.split()[50:][0] == f"w{512 + 462 * k}" for k, p in enumerate(got[1:]))


def test_chunks_of_many_blocks_are_numbered_through_and_texts_are_dealt_twice(spark, monkeypatch):
    made = []
    monkeypatch.setattr(G, "materialize", lambda df, name, f=G.materialize: made.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, name))
    rows = [("big", k, 0, f"{k:06} " + "x" * (120 if k % 3 else 20), 0, 0, None, None, None) for k in range(4000)]
    rows += [(s, k, 0, f"{k:06} " + "y" * 120, 0, 0, None, None, None) for s in ("small", None) for k in range(2)]
    schema = "source string, section_seq long, part int, text string, start_off long, end_off long, section string, subsection string, subsubsection string"
    got = G.fold_chunks(spark.createDataFrame(rows, schema)).collect()
    for source in ("big", "small", None):
        own = sorted((r["chunk_index"], r["text"]) for r in got if r["source"] == source)
        assert [i for i, _ in own] == list(range(len(own)))
        assert [t for _, t in own] == [p[0] for p in G.apply_size_guardrails((r[3], 0, 0, ()) for r in rows if r[0] == source)]
    assert made[0].count("Exchange") <= 5  # before 7
