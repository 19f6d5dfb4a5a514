import random

import pytest

#: Columns of documents plus extra ones whose names the operators use inside or in their results.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key long, norm string, fp long, size long, g long, e double, copies long, row string, "
    "sig binary, n_shingles long, kept boolean, found string, held_out string, langs string, ids string, label string, block int, shard int"
)
EXTRA = (7, "x", 3, 5, 5, 0.5, 9, "r", b"s", 4, False, "f", "h", "l", "i", "z", 1, 2)

LONG = ("the quick brown fox jumps over the lazy dog " * 9000).strip()
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, "b"), (4, LONG, "en", None), (5, "same text here", "en", "a"), (6, "same  text\nhere", "en", "b"),
    (6, "same  text\nhere", "en", "b"), (None, "no id on this one", "en", "a"), (None, None, None, None), (7, "одно слово 日本 😀 ▁x", None, "c"), (8, "12345 67890", "de", "c"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    return table(spark, EDGE)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture()
def rng():
    return random.Random(11)
