"""What kept queries from growing with their input: work in one task, and work done more than once."""

import random

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import cleaning
from leafmill.plans.fixtures import numbered_documents


def test_pages_are_numbered_in_blocks(spark):
    rnd = random.Random(5)
    ids = [None, -5000, -1, 0, 1, 1023, 1024, 1 << 62, *rnd.sample(range(-10_000, 100_000), 400)]
    docs = spark.createDataFrame([(n, rnd.choice(["a", "b", None]), rnd.choice([None, f"text {n}"])) for n in ids], "doc_id long, source string, text string")
    docs.createOrReplaceTempView("some_documents")
    want = spark.sql(
        "SELECT source, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, count(*) OVER (PARTITION BY source) AS total_pages "
        "FROM some_documents WHERE source IS NOT NULL"
    )
    got = numbered_documents(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # Texts are dealt by block, and not by source alone.
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in x]
    assert windows and all("block" in x.split("AS", 1)[1] for x in windows)


def test_cleaning_is_worked_out_once(spark):
    pages = spark.createDataFrame([("s", n, "exam-\nple  text\n" if n else " ") for n in range(4)], "source string, page int, page_content string")
    cleaned = cleaning.clean_pages(pages)
    assert {r["page_content"] for r in cleaned.collect()} == {"example text"} and cleaned.columns == pages.columns
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4


def test_rejoined_hyphens_are_those_of_the_plain_pattern(spark):
    rnd = random.Random(7)
    marks = ["a", "b", "-", "-", "\n", "\n", " ", "é", "\U00010400", "_", "9", "A", "\r"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 20))) for _ in range(3000)] + ["a-\nb-\nc-\nd", "-\nb", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", rf"([\p{{L}}\p{{N}}_])-{T.BLANK}*\n{T.BLANK}*([a-z])", "$1$2")
    assert df.where(plain != T.rejoin_hyphens(F.col("t"))).count() == 0 and df.where(plain != F.col("t")).count() > 20


def test_semantic_split_shuffles_nothing_and_cuts_as_the_windows_do(spark):
    from leafmill.operators import semantic
    from leafmill.operators.embed import embed

    rnd = random.Random(3)
    words = [f"w{n}" for n in range(30)]
    sentence = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 9))).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(n)) for n in (0, 1, 2, 3, 40, 60, 200)] + ["x" * 300, ". . . ? ! . " * 30, None]
    rows = [(f"s{n % 3}", n, "H", t, n, n + len(t or "")) for n, t in enumerate(texts)]
    sections = spark.createDataFrame(rows, "source string, section_seq int, section string, text string, start_off long, end_off long").where("text IS NOT NULL")
    parts = semantic.semantic_split(sections, max_size=100)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    long = sections.where("length(text) > 100").select("source", "section_seq", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    want = semantic.split_vectors(embed(long, "sentence"), ["source", "section_seq"])
    got = parts.where("section_seq IN (4, 5, 6, 7, 8)").select("source", "section_seq", "part", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    short = parts.where("section_seq < 2").collect()
    assert all(r["part"] == 0 and r["end_off"] - r["start_off"] == len(r["text"]) for r in short)
    many = [r for r in parts.collect() if r["section_seq"] == 6]
    assert len(many) > 3 and max(r["end_off"] for r in many) <= 6 + len(texts[6]) and min(r["start_off"] for r in many) == 6


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_sections_are_written_before_they_are_folded(spark, monkeypatch):
    from leafmill.operators import guardrails
    from leafmill.functions.sentences import sentences

    seen, fold = [], guardrails.fold_chunks
    monkeypatch.setattr(guardrails, "fold_chunks", lambda parts, *a: seen.append(_plan(parts)) or fold(parts, *a))
    text = "# One\n" + "Some words stand here, e.g. these. And Dr. Who came? " * 40
    assert guardrails.chunk_documents(spark.createDataFrame([("s", 0, text)], "source string, page int, page_content string")).count() > 1
    assert "MapInArrow" not in seen[0] and "Join" not in seen[0]
    rnd = random.Random(11)
    marks = ["a", "B", "É", " ", "  ", "\n", ". ", ".", "?", '"', ")", "Dr", "e.g", "I", "J", "9", "\x1c", "\U00010428", "vs.", " "]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    split = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_sentences(F.col("t")).alias("s"))
    assert all(r["s"] == sentences(r["t"]) for r in split.collect())


def test_pages_pass_the_gate_once(spark, monkeypatch):
    from leafmill.streaming import ingest

    seen, clean = [], ingest.clean_pages
    monkeypatch.setattr(ingest, "clean_pages", lambda pages: seen.append(_plan(pages)) or clean(pages))
    pages = spark.createDataFrame([("s", 0, "word " * 60), ("s", 1, "12 34")], "source string, page int, page_content string")
    assert ingest.index_pages(pages).count() == 1
    assert "regexp_replace" not in seen[0]


def test_words_are_counted_with_one_shuffle_and_texts_split_in_the_worker(spark):
    from leafmill.operators import borders

    docs = spark.createDataFrame([(1, "It rains. Dr. No sleeps.", "en")], "doc_id long, text string, lang string")
    assert "Exchange" not in borders.partial_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert borders.word_counts(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    split = docs.select(borders.Borders(frozenset({"en:dr"}), frozenset()).split(F.col("text"), F.col("lang")).alias("s"))
    assert "ArrowEvalPython" in _plan(split) and "transform(" not in _plan(split)
    assert split.first()["s"] == ["It rains.", "Dr. No sleeps."]


def test_words_of_many_batches_are_counted_whole(monkeypatch):
    """Against counting token by token; batches are smaller, and larger, than what a worker holds."""
    from collections import Counter

    import pyarrow as pa

    from leafmill.operators import borders as B

    rnd = random.Random(17)
    bits = ["a", "The", "b.", "Dr.", "x.y.", "..", "!", "?", '"', ")", "12", "İ", "ΑΣ.", "ß", "É", "\U00010428.", ",", "#"]
    blanks = [" ", " ", " ", "", "\n", "\x0b", "\x1c", "\x85", "\xa0", " "]
    rows = [(rnd.choice(["en", "de", ""]), "".join(rnd.choice(bits) + rnd.choice(blanks) for _ in range(rnd.randint(0, 40)))) for _ in range(300)] + [("", ""), ("en", " \n"), ("en", "word " * 2000)]
    want = Counter()
    for lang, text in rows:
        ahead = "!"
        for token in text.split():
            core, last = token.strip(T.AROUND), ahead.strip(T.AROUND)
            before = "!" if last.endswith(("!", "?", "..")) else B._word(last) + "." if last.endswith(".") else ""
            if B._word(core):
                for kind, seen in (("n", True), ("stop", B._stopped(core)), ("small", B._small(core)), ("capital", B._capital(core))):
                    want[lang, before, B._word(core), kind] += seen
            ahead = token
    for held, size in ((1 << 23, 100), (400, 50), (400, 1), (1, 303)):
        monkeypatch.setattr(B, "HELD", held)
        cut = [rows[at : at + size] for at in range(0, len(rows), size)]
        got = Counter()
        for part in B._count(pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*b)], ["lang", "text"]) for b in [*cut]):
            for r in part.to_pylist():
                for kind in ("n", "stop", "small", "capital"):
                    got[r["lang"], r["before"], r["word"], kind] += r[kind]
        assert got == want and sum(got.values()) > 5000
    assert list(B._count(iter([]))) == []
