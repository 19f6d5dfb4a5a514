"""The chunk store: Parquet in hash buckets of doc_id, with idempotent writes.

Rows lie in folders of their own write (``data-*``), by bucket; a manifest (``manifest-*``, a small Parquet table)
says which folder holds each bucket, and ``commit-<number>`` names the manifest that counts. A write makes new folders
for the buckets that it touches, then a manifest, then the next commit. A write that is cut short leaves the store
as it was, and readers always see one whole state.

Several may write at once: a commit is a file that only one writer can create (the file system must refuse to create a file
that exists, as HDFS and local disks do). Whoever comes second merges its chunks anew into the state it finds then. Folders
go one commit after the one that replaced them, so those who still read that state can end; who reads for longer than two
writes take has to begin again. What writers that died have left is removed by ``vacuum``.

Chunks are staged beside the store first. A large write stages and merges them in shares of its documents, so that what is
shuffled at once, and kept on disk for that, is a share of it (``write_shares``).

A write reads and rewrites the touched buckets only. Their number follows the store: it is doubled, in a write that
touches all of them, when buckets hold more than ``BUCKET_ROWS`` rows on average. The manifest has for each bucket the
range of its sources, and their names where they are ``NAMED`` at most; a read of some sources or documents opens
only the folders that may hold them. Rows lie sorted by source in a bucket, so Parquet's own statistics skip within it.
A manifest row also has a mergeable sketch of its sources, the smallest of them and the length of its vectors, from which
``store_stats`` describes the store without reading a data file.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from math import gcd

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

BUCKET_ROWS = 100_000

#: Sources of a bucket that its manifest row names; of more it has the range only.
NAMED = 64
#: Merges that a write tries while others commit before it.
TRIES = 20
#: Sources of a bucket that are kept as examples.
EXAMPLES = 5
#: Logarithm of a sketch's cells: the standard error of a count is 1.04 / sqrt(4096), some 1.6 percent.
SKETCH = 12

_STATS = ["folder", "n", "first", "last", "sources", "lowest", "sketch", "dimension"]
_MANIFEST = (
    "bucket int, folder string, n long, first string, last string, sources array<string>, lowest array<string>, sketch binary, dimension int, "
    "buckets int, layout string"
)


def _unique(chunks: DataFrame) -> DataFrame:
    """One row of each chunk_id: of several the one whose columns have the smallest hash."""
    row = F.struct(*[F.col(f"`{c}`") for c in chunks.columns])
    return chunks.groupBy("chunk_id").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in chunks.columns])).alias("row")).select("row.*")


def merged_chunks(store: DataFrame, new: DataFrame, key: str = "chunk_id", gone: DataFrame | None = None) -> DataFrame:
    """The store after a write: rows that share their ``key`` with a new row (or a row of ``gone``) go, the new ones
    (of unique chunk_id) come. With key ``chunk_id`` this is an upsert, with ``doc_id`` it replaces whole documents."""
    out = new.select(key) if gone is None else new.select(key).unionByName(gone.select(key))
    return store.join(out.distinct(), key, "left_anti").unionByName(new.select(*store.columns))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, p = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if n.startswith(prefix))


@dataclass
class _State:
    """A store as its last commit has it; a manifest row (``_STATS``) by bucket."""

    number: int
    buckets: int
    layout: str | None
    held: dict[int, tuple]

    @property
    def folders(self) -> dict[int, str]:
        return {b: row[0] for b, row in self.held.items()}

    @property
    def rows(self) -> dict[int, int]:
        return {b: row[1] for b, row in self.held.items()}


def _state(spark: SparkSession, path: str, number: int | None = None) -> _State:
    commits = [n for n in _names(spark, path, "commit-") if number is None or int(n.split("-")[1]) == number]
    if not commits:
        return _State(0, 0, None, {})
    manifest = spark.read.text(f"{path}/{commits[-1]}").first()[0]
    # One row for each bucket, of which there is one for many thousand rows.
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/{manifest}").collect()
    held = {r["bucket"]: tuple(r[c] for c in _STATS) for r in rows if r["folder"] is not None}
    return _State(int(commits[-1].split("-")[1]), rows[0]["buckets"], rows[0]["layout"], held)


def _commit(spark: SparkSession, path: str, number: int, manifest: str) -> bool:
    """Makes ``manifest`` the one that counts; false if another write has come first."""
    fs, p = _fs(spark, f"{path}/commit-{number:08d}")
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(f"{manifest}\n".encode()))
    out.close()
    return True


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, state: _State, which: list[int]) -> DataFrame:
    schema = StructType.fromJson(json.loads(state.layout))
    folders = [f"{path}/{state.folders[b]}/bucket={b}" for b in which]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _merge(shares: list[tuple[DataFrame, int]], path: str, key: str, buckets: int | None, gone: DataFrame | None, state: _State) -> tuple[str, str]:
    """Writes the touched buckets and the manifest of the state that follows ``state``: data folder, manifest. Buckets and
    shares that the same documents may be in are merged together, one such group after the other."""
    every = reduce(DataFrame.unionByName, [rows for rows, _ in shares])
    spark = every.sparkSession
    total = sum(n for _, n in shares) + sum(state.rows.values())
    count = state.buckets or buckets or 1
    while buckets is None and total > count * BUCKET_ROWS:
        count *= 2
    keys = every.select("doc_id") if gone is None else every.select("doc_id").unionByName(gone.select("doc_id"))
    # At most one number for each bucket.
    touched = sorted(state.held) if count != state.buckets else sorted(r[0] for r in keys.select(_bucket(count)).distinct().collect() if r[0] in state.held)
    name = uuid.uuid4().hex
    folder = f"data-{name}"
    order = [F.col("bucket"), *[F.col(c) for c in ("source",) if c in every.columns]]
    vectors = "embedding" in every.columns and isinstance(every.schema["embedding"].dataType, ArrayType)
    # A document's number modulo a divisor of both follows from its bucket as well as from its share.
    groups = gcd(count, len(shares))
    known = gcd(groups, state.buckets)  # as far as the old buckets tell it
    dimensions = []
    for n in range(groups):
        part = lambda rows, of: rows if of == groups else rows.where(_bucket(groups) == n)  # noqa: B023, E731
        near = [b for b in touched if b % known == n % known]
        merged = reduce(DataFrame.unionByName, [rows for rows, _ in shares[n::groups]])
        if state.layout:
            merged = merged_chunks(part(_read(spark, path, state, near), known), merged, key, None if gone is None else part(gone, 1))
        # A plan that is found to be empty as it runs has lost what it should observe.
        if not any(rows for _, rows in shares[n::groups]) and (not near or merged.isEmpty()):
            continue
        # The greatest length is taken as rows go by; a task that runs again does not change it.
        seen = Observation("vectors")
        merged = merged.observe(seen, F.max(F.size("embedding") if vectors else F.lit(None).cast("int")).alias("dimension"))
        dealt = merged.withColumn("bucket", _bucket(count)).repartition("bucket").sortWithinPartitions(*order)
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/{folder}")
        dimensions.append(seen.get["dimension"])
    held = {b: row for b, row in state.held.items() if b not in touched}
    if _names(spark, f"{path}/{folder}", "bucket="):
        made = spark.read.parquet(f"{path}/{folder}")
        own = F.col("source").cast("string") if "source" in made.columns else F.lit(None).cast("string")
        # Of each bucket the rows, and of its sources one row each, which then are counted.
        each = made.groupBy("bucket", own.alias("source")).agg(F.count(F.lit(1)).alias("n"))
        named = F.when(F.count("source") <= NAMED, F.collect_set(F.when(F.col("nth") <= NAMED, F.col("source"))))
        each = each.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("source")))
        lowest = F.collect_set(F.when(F.col("nth") <= EXAMPLES + 1, F.col("source")))  # one more, since null comes first
        stats = each.groupBy("bucket").agg(
            F.sum("n").alias("n"), F.min("source").alias("first"), F.max("source").alias("last"), named.alias("sources"),
            F.slice(F.array_sort(lowest), 1, EXAMPLES).alias("lowest"), F.hll_sketch_agg("source", F.lit(SKETCH)).alias("sketch"),
        )
        about = {"folder": folder, "dimension": max((d for d in dimensions if d is not None), default=None)}
        held |= {r["bucket"]: tuple((r.asDict() | about)[c] for c in _STATS) for r in stats.collect()}
    layout = state.layout or every.schema.json()
    lines = [(b, *row, count, layout) for b, row in sorted(held.items())] or [(None,) * (1 + len(_STATS)) + (count, layout)]
    manifest = f"manifest-{name}"
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.parquet(f"{path}/{manifest}")
    return folder, manifest


def _staged(chunks: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``chunks``, one row of each chunk_id, written below ``path``, and their number. They are made once, and dealt out anew
    only if an id repeats."""
    spark = chunks.sparkSession

    def stored(df: DataFrame, to: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(to)
        return spark.read.schema(chunks.schema).parquet(to)

    rows = stored(chunks, f"{path}/all")
    count, ids = rows.groupBy("chunk_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    if ids < count:
        rows = stored(_unique(rows), f"{path}/unique")
        _delete(spark, f"{path}/all")
    return rows, ids


def _write(shares: Iterable[DataFrame], path: str, key: str, buckets: int | None, gone: DataFrame | None = None) -> int:
    stage = f"{path}/stage-{uuid.uuid4().hex}"
    # Chunks are made once, beside the store; what is merged is read from there.
    staged = [_staged(chunks, f"{stage}/{n}") for n, chunks in enumerate(shares)]
    spark, written = staged[0][0].sparkSession, sum(n for _, n in staged)
    for n in range(TRIES):
        state = _state(spark, path)
        try:
            folder, manifest = _merge(staged, path, key, buckets, gone, state)
        except Exception:
            # The state may have gone while it was read; without a newer one this is an error like any other.
            if n + 1 < TRIES and _state(spark, path).number > state.number + 1:
                continue
            raise
        if _commit(spark, path, state.number + 1, manifest):
            _forget(spark, path, state.number)
            _delete(spark, stage)
            return written
        for lost in (folder, manifest):
            _delete(spark, f"{path}/{lost}")
    raise RuntimeError(f"{TRIES} other writes came first at {path}")


def _forget(spark: SparkSession, path: str, number: int) -> None:
    """Removes what the commit before ``number`` has and neither ``number`` nor a later one needs."""
    if f"commit-{number - 1:08d}" not in _names(spark, path, "commit-"):
        return
    old, kept = _state(spark, path, number - 1), [_state(spark, path, number), _state(spark, path)]
    needed = {(b, f) for s in kept for b, f in s.folders.items()}
    for b, f in old.folders.items():
        if (b, f) not in needed:
            _delete(spark, f"{path}/{f}/bucket={b}")
    for f in set(old.folders.values()) - {f for _, f in needed}:
        _delete(spark, f"{path}/{f}")
    name = f"{path}/commit-{number - 1:08d}"
    _delete(spark, f"{path}/{spark.read.text(name).first()[0]}")
    _delete(spark, name)


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> list[str]:
    """Removes folders that no commit needs and nothing has changed for so many hours: what writers that died have left."""
    commits = _names(spark, path, "commit-")
    needed = {f for n in commits for f in _state(spark, path, int(n.split("-")[1])).folders.values()} | {spark.read.text(f"{path}/{n}").first()[0] for n in commits}
    fs, p = _fs(spark, path)
    gone = []
    for s in fs.listStatus(p):
        name, age = s.getPath().getName(), time.time() - s.getModificationTime() / 1000
        if name.startswith(("data-", "stage-", "manifest-")) and name not in needed and age >= 3600 * hours:
            _delete(spark, f"{path}/{name}")
            gone.append(name)
    return sorted(gone)


def upsert_chunks(chunks: DataFrame, path: str, buckets: int | None = None) -> int:
    """Insert or replace by chunk_id; returns the number of rows written. Writing the same chunks again
    changes nothing. Rows of a document that became shorter stay (see ``replace_source``). ``buckets`` fixes the
    number of buckets of a new store."""
    return _write([chunks], path, "chunk_id", buckets)


def replace_source(chunks: DataFrame, path: str, documents: DataFrame | None = None, buckets: int | None = None) -> int:
    """Fresh mode: afterwards the documents of ``chunks``, and those that ``documents`` (doc_id) names, hold nothing
    but these chunks; a document that has none now is gone."""
    return _write([chunks], path, "doc_id", buckets, documents)


def share(shares: int):
    """The share that a row's doc_id is in, for ``write_shares``."""
    return _bucket(shares)


def write_shares(shares: Iterable[DataFrame], path: str, documents: DataFrame | None = None, fresh: bool = True, buckets: int | None = None) -> int:
    """``replace_source`` (or, if not ``fresh``, ``upsert_chunks``) of chunks that come as one table for each ``share``, in their order:
    one write like any other. Each table is staged before the next one is asked for, and the stage and the merged data are all that is
    kept of those before it."""
    return _write(shares, path, "doc_id" if fresh else "chunk_id", buckets, documents if fresh else None)


def store_stats(spark: SparkSession, path: str) -> DataFrame:
    """``reports.collection_stats`` of a store from its manifest: chunks, metric, dimension, sources (from merged sketches, within some
    percent where there are many), sample_sources. The dimension is the greatest of the writes that made the buckets."""
    state = _state(spark, path)
    if state.layout is None:
        raise ValueError(f"no store at {path}")
    rows = spark.createDataFrame([(b, *row, 0, "") for b, row in sorted(state.held.items())], _MANIFEST)
    some = rows.select(F.explode("lowest").alias("source")).distinct().orderBy("source").limit(EXAMPLES)
    names = some.agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sample_sources"))
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.max("dimension").alias("dimension"), F.coalesce(union, F.lit(0)).alias("sources"))
    return total.join(F.broadcast(names), F.lit(True)).withColumn("metric", F.lit("cosine"))  # one row each


def _may_hold(row: tuple, source: str) -> bool:
    _, _, first, last, sources, *_ = row
    return source in sources if sources is not None else first is not None and first <= source <= last


def read_store(spark: SparkSession, path: str, doc_id: str | None = None, source: str | None = None) -> DataFrame:
    """All rows, or those of a document (for which one bucket is read) or of a source (for which the buckets are read
    whose statistics allow it)."""
    state = _state(spark, path)
    if state.layout is None:
        raise ValueError(f"no store at {path}")
    which = sorted(state.held)
    if doc_id is not None:
        own = spark.range(1).select(F.lit(doc_id).alias("doc_id")).select(_bucket(state.buckets)).first()[0]
        which = [b for b in which if b == own]
    if source is not None:
        which = [b for b in which if _may_hold(state.held[b], source)]
    rows = _read(spark, path, state, which)
    for name, value in (("doc_id", doc_id), ("source", source)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def read_documents(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """The rows of the documents that ``documents`` (doc_id) names. Only their buckets are opened."""
    state = _state(spark, path)
    if state.layout is None:
        raise ValueError(f"no store at {path}")
    # At most one number for each bucket.
    which = sorted(r[0] for r in documents.select(_bucket(state.buckets)).distinct().collect() if r[0] in state.held)
    rows = _read(spark, path, state, which)
    return rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select(*rows.columns)


def has_store(spark: SparkSession, path: str) -> bool:
    return _state(spark, path).layout is not None


def write_questions(quiz: DataFrame, path: str, fmt: str = "json") -> None:
    quiz.write.mode("overwrite").format(fmt).save(path)
