"""Every registered query of the library against its DuckDB SQL, and the entry module's contract."""

from functools import partial

import pytest

from leafmill import registry
from leafmill.operators import sections

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, same_rows, name):
    same_rows(registry.queries()[name](spark, sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES) - {"ingest_stream"}))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_concat_pages_of_many_parts_is_one_row_a_source(spark, sf_dir, same_rows, monkeypatch):
    monkeypatch.setattr(sections, "concat_pages", partial(sections.concat_pages, part_chars=5000))
    same_rows(registry.queries()["concat_pages"](spark, sf_dir), ORACLES["concat_pages"])


def test_a_source_too_large_for_a_row_keeps_its_parts(spark):
    pages = spark.createDataFrame([("a", 0, "x" * 30), ("a", 1, "y" * 30), (None, 0, "z"), (None, 1, "z")], "source string, page int, page_content string")
    got = sections.whole_texts(sections.concat_pages(pages, 20), 60).collect()
    assert sorted((r["source"] or "", r["part"], r["text"], r["n_pages"]) for r in got) == [
        ("", 0, "z\n\nz\n\n", 2), ("a", 0, "x" * 30 + "\n\n", 1), ("a", 1, "y" * 30 + "\n\n", 1),
    ]


def test_discover_files_of_a_folder_is_one_table(spark, sf_dir, same_rows, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    same_rows(registry.queries()["discover_files"](spark, str(tmp_path)), ORACLES["discover_files"])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
