import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators.embed import embed, embed_cached
from leafmill.plans.fixtures import fixture
from leafmill.sources import pages as P
from leafmill.sources import store as S
from leafmill.sources import vectors as V
from leafmill.streaming import ingest

CHUNK = "chunk_id string, doc_id string, text string"


def rows(df):
    return sorted(map(tuple, df.select("chunk_id", "doc_id", "text").collect()))


def test_files(spark, tmp_path):
    for name, body in (("b.PDF", "2"), ("a.pdf", "1"), ("c.txt", "3")):
        (tmp_path / name).write_text(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_text("4")
    found = P.discover_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.pdf", "b.PDF"]
    with pytest.raises(ValueError):
        P.discover_files(spark, str(tmp_path), "docx")

    def parser(path, content):
        if content == b"2":
            raise RuntimeError("broken")
        return [{"page": 0, "page_content": content.decode()}, {"page": 1, "page_content": "x"}]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(str(tmp_path))
    got = P.parse_files(files, parser).collect()
    assert [(r["source"], r["page"], r["error"]) for r in sorted(got, key=lambda r: (r["source"], r["page"] or 0))] == [
        ("a.pdf", 0, None), ("a.pdf", 1, None), ("b.PDF", None, "RuntimeError: broken")]


def test_bad_json_rows(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"source": "a", "page": 1, "page_content": "x"}) + "\n{bad\n")
    df = P.load_pages(spark, str(tmp_path / "p.json"), "json").cache()
    assert df.where("_corrupt_record IS NULL").count() == 1 and df.where("_corrupt_record IS NOT NULL").count() == 1
    ids = [r["doc_id"] for r in P.attach_doc_id(df).where("source = 'a'").collect()]
    assert len(ids[0]) == 9


def test_upsert_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([(f"c{k}", f"d{k % 5}", "old") for k in range(20)], CHUNK)
    new = spark.createDataFrame([("c1", "d1", "new"), ("x", "d1", "new")], CHUNK)
    assert S.upsert_chunks(old, path) == 20
    assert S.upsert_chunks(new, path) == 2
    once = rows(S.read_store(spark, path))
    S.upsert_chunks(new, path)
    assert rows(S.read_store(spark, path)) == once and len(once) == 21 and ("c1", "d1", "new") in once
    S.replace_source(new, path)
    assert rows(S.read_store(spark, path, "d1")) == [("c1", "d1", "new"), ("x", "d1", "new")]
    assert S.read_store(spark, path).count() == 18


def test_replaced_documents_vanish(spark, tmp_path):
    path = str(tmp_path / "store")
    S.replace_source(spark.createDataFrame([("c1", "d1", "x"), ("c2", "d2", "y"), ("c3", "d2", "z")], CHUNK), path)
    seen = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    S.replace_source(spark.createDataFrame([("c9", "d2", "new")], CHUNK), path, seen)
    assert rows(S.read_store(spark, path)) == [("c9", "d2", "new")] and S.read_store(spark, path, "d1").count() == 0
    S.replace_source(spark.createDataFrame([], CHUNK), path, seen)
    assert S.read_store(spark, path).count() == 0
    S.upsert_chunks(spark.createDataFrame([("c5", "d5", "back")], CHUNK), path)
    assert rows(S.read_store(spark, path)) == [("c5", "d5", "back")]
    with pytest.raises(ValueError, match="no store"):
        S.read_store(spark, str(tmp_path / "nowhere"))


def test_a_write_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    S.upsert_chunks(spark.createDataFrame([(f"c{k}", f"d{k % 7}", "old") for k in range(40)], CHUNK), path, buckets=4)
    old = rows(S.read_store(spark, path))
    new = spark.createDataFrame([(f"c{k}", f"d{k % 7}", "new") for k in range(40)], CHUNK)
    real = spark.createDataFrame

    def broken(data, schema=None, **more):
        if schema == S._MANIFEST:
            raise RuntimeError("lost before the manifest")
        return real(data, schema, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: broken(*a, **k))
    with pytest.raises(RuntimeError):
        S.upsert_chunks(new, path)
    monkeypatch.undo()
    assert rows(S.read_store(spark, path)) == old
    S.upsert_chunks(new, path)
    assert {r[2] for r in rows(S.read_store(spark, path))} == {"new"} and len(rows(S.read_store(spark, path))) == 40
    left = S.vacuum(spark, path, 0)
    assert any(n.startswith("stage-") for n in left) and S.vacuum(spark, path, 0) == []
    assert len(rows(S.read_store(spark, path))) == 40


def test_interleaved_writers_both_survive(spark, tmp_path, monkeypatch):
    """A second writer commits while the first has merged but not committed; then one while the first still merges."""
    path = str(tmp_path / "store")
    S.upsert_chunks(spark.createDataFrame([(f"c{k}", f"d{k % 5}", "old") for k in range(20)], CHUNK), path, buckets=2)
    real, others = S._commit, [[("c1", "d1", "second"), ("x", "d1", "second")], [("y", "d2", "third")]]

    def late(spark_, path_, number, manifest):
        if others:
            other = spark.createDataFrame(others.pop(), CHUNK)
            with monkeypatch.context() as m:
                m.setattr(S, "_commit", real)
                S.upsert_chunks(other, path_)
        return real(spark_, path_, number, manifest)

    monkeypatch.setattr(S, "_commit", late)
    assert S.upsert_chunks(spark.createDataFrame([("c2", "d2", "first"), ("z", "d4", "first")], CHUNK), path) == 2
    monkeypatch.undo()
    got = rows(S.read_store(spark, path))
    want = {f"c{k}": (f"c{k}", f"d{k % 5}", "old") for k in range(20)} | {r[0]: r for r in [("c1", "d1", "second"), ("x", "d1", "second"), ("y", "d2", "third"), ("c2", "d2", "first"), ("z", "d4", "first")]}
    assert got == sorted(want.values())
    assert S._state(spark, path).number == 4
    assert len(S._names(spark, path, "commit-")) == 2 and S._names(spark, path, "stage-") == []


def test_a_commit_has_one_winner(spark, tmp_path):
    path = str(tmp_path)
    assert [S._commit(spark, path, 1, f"m{k}") for k in range(3)] == [True, False, False]
    assert spark.read.text(f"{path}/commit-00000001").first()[0] == "m0"


def test_filtered_reads_open_matching_folders_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "NAMED", 3)
    path = str(tmp_path / "store")
    kind = f"{CHUNK}, source string"
    data = [(f"c{k}", f"d{k % 40}", f"t{k}", f"s{k % 40:02d}") for k in range(200)] + [("n", "d99", "no source", None)]
    S.upsert_chunks(spark.createDataFrame(data, kind), path, buckets=16)
    state = S._state(spark, path)
    for k in (0, 7, 39):
        found = S.read_store(spark, path, source=f"s{k:02d}")
        assert rows(found) == sorted(r[:3] for r in data if r[3] == f"s{k:02d}")
        folders = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles()}
        allowed = {str(b) for b, row in state.held.items() if S._may_hold(row, f"s{k:02d}")}
        assert folders == allowed and len(folders) < len(state.held)
    named = [row[4] for row in state.held.values()]
    assert any(x is None for x in named) and any(x is not None for x in named)  # both kinds of statistics are met
    assert rows(S.read_store(spark, path, source="nowhere")) == [] and S.read_store(spark, path, source="zz").inputFiles() == []
    assert rows(S.read_store(spark, path, "d7", "s07")) == rows(S.read_store(spark, path, "d7"))


def test_statistics_without_a_data_file(spark, tmp_path):
    path = str(tmp_path / "store")
    kind = f"{CHUNK}, source string, embedding array<float>"
    data = [(f"c{k}", f"d{k}", "x", f"s{k % 3000:04d}" if k % 9 else None, [0.5] * 4) for k in range(6000)]
    S.upsert_chunks(spark.createDataFrame(data[:4000], kind), path, buckets=8)
    S.upsert_chunks(spark.createDataFrame(data[3000:], kind), path)
    for folder in S._state(spark, path).folders.values():
        S._delete(spark, f"{path}/{folder}")  # what is not there cannot be read
    got = S.store_stats(spark, path).first().asDict()
    names = {r[3] for r in data if r[3]}
    assert abs(got["sources"] - len(names)) <= 0.05 * len(names)
    want = {"chunks": 6000, "dimension": 4, "sample_sources": ",".join(sorted(names)[:5]), "metric": "cosine"}
    assert {c: got[c] for c in want} == want


def test_statistics_of_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    S.upsert_chunks(spark.createDataFrame([], f"{CHUNK}, source string"), path)
    assert S.store_stats(spark, path).first().asDict() == {"chunks": 0, "dimension": None, "sources": 0, "sample_sources": "", "metric": "cosine"}


def test_buckets_follow_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 10)
    path = str(tmp_path / "store")
    want = []
    for n in range(4):
        more = [(f"c{n}-{k}", f"d{n}-{k}", "t") for k in range(15)]
        S.upsert_chunks(spark.createDataFrame(more, CHUNK), path)
        want += more
        assert rows(S.read_store(spark, path)) == sorted(want)
    assert S._state(spark, path).buckets == 8 and sum(S._state(spark, path).rows.values()) == 60
    assert rows(S.read_store(spark, path, "d2-3")) == [("c2-3", "d2-3", "t")]


def test_repeated_chunk_ids_have_one_winner(spark, tmp_path):
    same = [("c1", "d1", x) for x in ("a", "b", "c")]
    kept = []
    for n, order in enumerate((same, same[::-1])):
        S.upsert_chunks(spark.createDataFrame(order, CHUNK).repartition(3), str(tmp_path / f"s{n}"))
        kept.append(rows(S.read_store(spark, str(tmp_path / f"s{n}"))))
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_embedding_hook_and_cache(spark):
    def loader():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("aa",), ("b",), ("b",), (None,)], "text string")
    got = [r["embedding"] for r in embed(df, loader=loader).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in got)
    cache = embed(df.where("text = 'aa'"), loader=loader).select(F.sha2("text", 256).alias("text_sha256"), "embedding")
    full, fresh = embed_cached(df, cache, loader=loader)
    assert full.where("embedding IS NULL").count() == 0 and fresh.count() == 2


def test_a_second_ingest_embeds_nothing(spark, tmp_path, monkeypatch):
    said = spark.sparkContext.accumulator(0)

    def loader():
        def model(texts):
            said.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    page = "source string, page int, page_content string"
    text = " ".join(["enough words to pass the gate"] * 10) + "."
    pages = spark.createDataFrame([("a", 0, text), ("b", 0, text + " More words of its own here.")], page)
    cache = str(tmp_path / "cache")
    plain = [(r["chunk_id"], r["embedding"]) for r in ingest.index_pages(pages, loader).orderBy("chunk_id").collect()]
    once = said.value
    for n in range(3):
        got = [(r["chunk_id"], r["embedding"]) for r in ingest.index_pages(pages, loader, cache).orderBy("chunk_id").collect()]
        assert got == plain
        assert said.value == once + V.read_vectors(spark, cache).count()  # each text of the cache was embedded once
    assert len(V._whole(spark, cache)) == 1


def test_vector_cache_merges_and_counts_a_text_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FOLDERS", 3)
    path, want = str(tmp_path / "cache"), {}
    assert V.read_vectors(spark, path).count() == 0
    for n in range(6):
        V.add_vectors(spark.createDataFrame([(f"h{k}", [float(k)]) for k in range(n, n + 3)], V.VECTORS), path)
        want |= {f"h{k}": [float(k)] for k in range(n, n + 3)}
        assert {r[0]: r[1] for r in V.read_vectors(spark, path).collect()} == want
        assert V.read_vectors(spark, path).count() == len(want) and len(V._whole(spark, path)) <= 3
    (tmp_path / "cache" / "part-cut-short").mkdir()
    assert V.read_vectors(spark, path).count() == len(want)


def test_a_source_that_fails_the_gate_now_vanishes(spark, tmp_path):
    page = "source string, page int, page_content string"
    good = " ".join(["enough words to pass the gate"] * 10) + "."
    store = str(tmp_path / "store")
    for n, text in enumerate((good, "too short")):
        src = str(tmp_path / f"in{n}")
        spark.createDataFrame([("a", 0, text), ("b", 0, good)], page).coalesce(1).write.parquet(src)
        ingest.ingest_stream(spark.readStream.schema(page).parquet(src), store, str(tmp_path / f"c{n}")).awaitTermination()
        assert {r["source"] for r in S.read_store(spark, store).collect()} == ({"a", "b"} if n == 0 else {"b"})


def test_stream_equals_batch_and_replays(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    book = fixture(spark, sf_dir, "doc_pages").where("source < 'doc_2'").withColumn("page", F.col("page").cast("int"))
    book.where("source < 'doc_15'").coalesce(1).write.parquet(str(src / "one"))
    book.where("source >= 'doc_15'").coalesce(1).write.parquet(str(src / "two"))
    stream = lambda: spark.readStream.schema(book.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    store = str(tmp_path / "store")
    ingest.ingest_stream(stream(), store, str(tmp_path / "c1")).awaitTermination()
    want = rows(ingest.index_pages(book))
    assert rows(S.read_store(spark, store)) == want
    ingest.ingest_stream(stream(), store, str(tmp_path / "c2"), fresh=False).awaitTermination()
    assert rows(S.read_store(spark, store)) == want
