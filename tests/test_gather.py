"""Sources that arrive in parts: the store is that of a batch, state goes with the sources, time gives out the rest."""

import random
import time

from pyspark.sql import functions as F

from leafmill import registry
from leafmill.plans import queries
from leafmill.plans.fixtures import fixture
from leafmill.session import _scratch
from leafmill.sources import store as S
from leafmill.streaming import gather as G
from leafmill.streaming import ingest

PAGES = "source string, page int, total_pages int, page_content string"


def parts(spark, rows, folder, n, seed=1):
    """``rows`` shuffled into n files, which arrive one by one."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(n):
        spark.createDataFrame(rows[k::n], PAGES).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in the order of their times


def stream(spark, folder):
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, folder, out, checkpoint, timeout=3600.0):
    with G.keyed_state(spark):
        sink = G.gathered_pages(stream(spark, folder), timeout).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = sink.format("parquet").start(out)
    query.awaitTermination()
    return query


def read(spark, out):
    return sorted(tuple(r) for r in spark.read.schema(G.GATHERED).parquet(out).collect())


def test_pages_over_several_batches_make_the_batch_store(spark, sf_dir, tmp_path):
    book = fixture(spark, sf_dir, "doc_pages").where("source < 'doc_105'").withColumn("page", F.col("page").cast("int"))
    rows = book.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("total_pages")).join(book, "source").select("source", "page", "total_pages", "page_content").collect()
    assert max(r["total_pages"] for r in rows) > 1
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    parts(spark, rows, src, 2)
    before = len(_scratch(spark))
    query = ingest.ingest_parts(stream(spark, src), store, str(tmp_path / "c"))
    query.awaitTermination()
    assert len(_scratch(spark)) == before  # no batch leaves scratch tables
    got = sorted(map(tuple, S.read_store(spark, store).select("chunk_id", "doc_id", "text").collect()))
    want = sorted(map(tuple, ingest.index_pages(book).select("chunk_id", "doc_id", "text").collect()))
    assert got == want
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    assert max(held) > 0 and held[-1] == 0  # state is there in between and gone at the end


def test_repeats_unknown_totals_and_a_second_round(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a", 0, 3, "a0 old"), ("b", 0, None, "b0"), (None, 0, 1, "no source"), ("c", None, 1, "no page")],
        [("a", 0, 3, "a0"), ("a", 2, None, "a2"), ("d", 5, 1, "d5")],
        [("a", 1, 2, "a1"), ("b", 1, 0, None)],
        [("a", 0, 1, "again")],
    ]
    for b in batches:
        spark.createDataFrame(b, PAGES).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    run(spark, src, out, str(tmp_path / "c"))
    assert read(spark, out) == [("a", 0, 1, "again", True), ("a", 0, 3, "a0", True), ("a", 1, 3, "a1", True), ("a", 2, 3, "a2", True), ("d", 5, 1, "d5", True)]


def test_time_gives_out_what_is_not_whole(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 0, 3, "a0"), ("b", 0, None, "b0")], PAGES).coalesce(1).write.parquet(src)
    run(spark, src, out, str(tmp_path / "c"), 1.0)
    assert read(spark, out) == []
    time.sleep(1.5)
    spark.createDataFrame([("x", 0, 2, "x0")], PAGES).coalesce(1).write.mode("append").parquet(src)
    run(spark, src, out, str(tmp_path / "c"), 1.0)
    assert read(spark, out) == [("a", 0, 3, "a0", False), ("b", 0, None, "b0", False)]


def test_a_source_of_many_pages_comes_in_pieces(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("big", k, 1500, f"page {k}") for k in range(1500)]
    parts(spark, rows, src, 3)
    run(spark, src, out, str(tmp_path / "c"))
    assert [r[1] for r in read(spark, out)] == list(range(1500))


def test_files_of_the_query_grow_in_number_with_the_pages(spark, sf_dir, same_rows, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "PART_ROWS", 10)
    monkeypatch.setattr(queries, "materialize", lambda df, name, f=queries.materialize: made.append(f(df, name)) or made[-1])
    same_rows(registry.queries()["gather_pages"](spark, sf_dir), registry.oracle_sql()["gather_pages"])
    assert len(made[0].inputFiles()) > 16  # 200 pages; before eight files, whatever came
