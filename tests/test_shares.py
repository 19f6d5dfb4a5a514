"""A large batch is indexed and written in shares: the store is the same, and the disk that it takes meanwhile is a share's."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from leafmill.plans.fixtures import fixture
from leafmill.session import shared_dir
from leafmill.sources import store as S
from leafmill.streaming import ingest

CHUNK = "chunk_id string, doc_id string, text string, source string, embedding array<float>"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _chunks(documents, text, per=3):
    """A table of chunks of the documents (None is one)."""
    return [(f"{d}-{k}", d, text, d and f"s{d}", [0.5] * 4) for d in documents for k in range(per)]


@pytest.mark.parametrize("buckets,fresh", [(None, True), (6, True), (4, False)])
def test_shares_make_the_same_store(spark, tmp_path, monkeypatch, buckets, fresh):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    seen = spark.createDataFrame([(f"d{k}",) for k in range(30)] + [(None,)], "doc_id string")
    writes = [(_chunks([f"d{k}" for k in range(5)], "old"), 1), (_chunks([*[f"d{k}" for k in range(2, 40, 2)], None], "new", 2), 8), (_chunks(["d39"], "last"), 4)]
    for n, (data, shares) in enumerate(writes):
        data = spark.createDataFrame([*data, *data[:3]], CHUNK)  # some ids repeat
        gone = seen if n == 1 else None
        wrote = S.replace_source(data, one, gone, buckets) if fresh else S.upsert_chunks(data, one, buckets)
        parts = (data.where(S.share(shares) == k) for k in range(shares))
        assert S.write_shares(parts, many, gone, fresh, buckets) == wrote
        assert _rows(S.read_store(spark, many)) == _rows(S.read_store(spark, one))
        a, b = S._state(spark, one), S._state(spark, many)
        assert a.buckets == b.buckets and a.number == b.number
        assert {k: (*v[1:4], v[7]) for k, v in a.held.items()} == {k: (*v[1:4], v[7]) for k, v in b.held.items()}
        assert _rows(S.read_store(spark, many, "d4")) == _rows(S.read_store(spark, one, "d4"))
    assert S._names(spark, many, "stage-") == []


def test_shares_are_merged_anew_when_another_write_comes_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    S.replace_source(spark.createDataFrame(_chunks([f"d{k}" for k in range(20)], "old"), CHUNK), path, buckets=4)
    real, others = S._commit, [_chunks(["d1", "x"], "other")]

    def late(spark_, path_, number, manifest):
        if others:
            with monkeypatch.context() as m:
                m.setattr(S, "_commit", real)
                S.replace_source(spark.createDataFrame(others.pop(), CHUNK), path_)
        return real(spark_, path_, number, manifest)

    monkeypatch.setattr(S, "_commit", late)
    new = spark.createDataFrame(_chunks([f"d{k}" for k in range(2, 30)], "new"), CHUNK)
    S.write_shares((new.where(S.share(4) == k) for k in range(4)), path)
    want = spark.createDataFrame(_chunks(["d0"], "old") + _chunks(["d1", "x"], "other"), CHUNK).unionByName(new)
    assert _rows(S.read_store(spark, path)) == _rows(want)


def test_no_row_is_dealt_out_before_it_is_staged(spark, tmp_path):
    same = spark.createDataFrame([("c1", "d", x, "s", [1.0]) for x in ("a", "b")], CHUNK)
    rows, n = S._staged(spark.range(50).select(F.col("id").cast("string").alias("chunk_id")), str(tmp_path / "a"))
    assert n == rows.count() == 50 and os.listdir(tmp_path / "a") == ["all"]
    rows, n = S._staged(same, str(tmp_path / "b"))
    assert n == rows.count() == 1 and os.listdir(tmp_path / "b") == ["unique"]


def _shuffled(spark):
    """Data files of shuffles, by name."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: os.path.getsize(f) for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True) if os.path.exists(f)}


def test_what_a_batch_took_is_gone_when_it_is_committed(spark, sf_dir, tmp_path, monkeypatch):
    """Before, five copies of the texts and the files of all shuffles were there until the batch had been written."""
    top = shared_dir(spark).removeprefix("file:")
    made, real = set(os.listdir(top)), S._commit
    found = []

    def commit(*a):
        found.append(sorted({n.split("-")[0] for n in set(os.listdir(top)) - made}))
        return real(*a)

    monkeypatch.setattr(S, "_commit", commit)
    book = fixture(spark, sf_dir, "doc_pages").withColumn("page", F.col("page").cast("int"))
    pages = book.select("source", "page", "page_content").where("source < 'doc_11'").union(spark.createDataFrame([(None, 0, "Too short."), ("short", 0, None)], "source string, page int, page_content string"))
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    pages.coalesce(1).write.parquet(src)
    want = _rows(ingest.index_pages(spark.read.parquet(src)))
    made |= set(os.listdir(top))
    before = _shuffled(spark)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    ingest.ingest_stream(stream(), store, str(tmp_path / "c1")).awaitTermination()
    assert found and set(found[0]) <= {"useful", "seen"}
    ends = time.time() + 20
    while time.time() < ends and (left := {f: n for f, n in _shuffled(spark).items() if f not in before}):
        time.sleep(0.2)  # files go in the background
    assert left == {}
    assert _rows(S.read_store(spark, store)) == want
    # In many shares it is the same store, and nothing else is left.
    monkeypatch.setattr(ingest, "SHARE_CHARS", 10_000)
    ingest.ingest_stream(stream(), f"{store}-2", str(tmp_path / "c2")).awaitTermination()
    assert _rows(S.read_store(spark, f"{store}-2")) == want
    assert set(os.listdir(top)) <= made
    assert spark.conf.get(ingest._CLEANUP) == "false"  # the caller's session stays as it was
