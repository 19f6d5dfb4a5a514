"""Structured Streaming: pages into the chunk store, and running quiz scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions import text as T
from leafmill.operators.cleaning import clean_pages
from leafmill.operators.embed import embed, embed_cached
from leafmill.operators.guardrails import chunk_documents
from leafmill.operators.pages import quality_gate, useful_pages
from leafmill.operators.reports import score_sessions
from leafmill.session import drop_scratch, materialize, scratch_mark, scratch_path
from leafmill.sources.store import _delete, has_store, read_documents, read_store, share, upsert_chunks, write_shares
from leafmill.sources.vectors import add_vectors, read_vectors
from leafmill.streaming.gather import gathered_pages, keyed_state


#: Characters of useful text up to which a batch is indexed as a whole; a larger one is in 2 or more, at most SHARES, shares.
SHARE_CHARS, SHARES = 1 << 27, 4
#: Removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def index_pages(pages: DataFrame, loader: Callable[[], Callable] | None = None, cache: str | None = None, **chunking) -> DataFrame:
    """Gate, clean, chunk and embed: the rows of the chunk store. With ``cache``, the folder of a vector cache, only
    chunk texts that it lacks are embedded, and their vectors are added to it."""
    # Pages are counted and cleaned, so they pass the gate once.
    return _index_useful(materialize(useful_pages(pages).select("source", "page", "page_content"), "useful"), loader, cache, **chunking)


def _index_useful(pages: DataFrame, loader: Callable[[], Callable] | None = None, cache: str | None = None, **chunking) -> DataFrame:
    chunks = chunk_documents(clean_pages(pages), loader=loader, **chunking)
    chunks = chunks.withColumn("doc_id", T.attach_doc_id(F.col("source")))
    if cache is None:
        return embed(chunks, "text", "embedding", loader)
    full, fresh = embed_cached(materialize(chunks, "chunks"), read_vectors(pages.sparkSession, cache), "text", loader)
    full = materialize(full.drop("text_sha256"), "embedded")  # before the cache is written, and perhaps merged
    if not fresh.isEmpty():
        add_vectors(fresh, cache)
    return full


def _shares(useful: DataFrame, path: str, shares: int, loader: Callable[[], Callable] | None) -> Iterator[DataFrame]:
    """The chunks of one share of the pages below ``path`` after the other. What a share took is removed when the next one is asked for."""
    spark = useful.sparkSession
    for n in range(shares):
        mark = scratch_mark(spark)
        yield _index_useful(useful.where(F.col("_share") % shares == n).drop("_share"), loader)
        drop_scratch(spark, mark)
        for k in range(n, SHARES, shares):
            _delete(spark, f"{path}/_share={k}")


def ingest_stream(
    pages: DataFrame, store: str, checkpoint: str, fresh: bool = True, loader: Callable[[], Callable] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Each micro-batch of pages is indexed and written; chunk ids are stable and writes idempotent, so a
    replayed batch leaves the store as it was. All pages of a source must arrive in one micro-batch (one
    file), as uploads do; see ``ingest_parts`` where they do not. With ``fresh`` a source that comes again replaces
    its old chunks, also when nothing of it passes the gate now.

    A batch is read once and one write to the store, but a large one is indexed in shares of its sources. A share's scratch tables
    and shuffles go before the next one begins, so the disk that they take is a share of the batch's."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession  # the stream's own
        spark.conf.set(_CLEANUP, "true")
        mark = scratch_mark(spark)
        # Of a page that fails the gate the source stays, since it was seen.
        text = F.when(F.col("gate_reason") == "ok", F.col("page_content")).alias("page_content")
        gated = quality_gate(batch).select("source", "page", text, T.attach_doc_id(F.col("source")).alias("doc_id"))
        dealt = gated.withColumn("_share", share(SHARES))
        size, path = Observation("useful"), scratch_path(spark, "useful")
        dealt.observe(size, F.sum(F.length("page_content")).alias("chars")).write.partitionBy("_share").parquet(path)
        pages = spark.read.schema(dealt.schema).parquet(path)
        seen = materialize(pages.select("doc_id").distinct(), "seen")
        shares = 1
        while shares < SHARES and (size.get["chars"] or 0) > shares * SHARE_CHARS:
            shares *= 2
        useful = pages.where("page_content IS NOT NULL").drop("doc_id")
        write_shares(_shares(useful, path, shares, loader), store, seen, fresh)
        drop_scratch(spark, mark)

    out = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def ingest_parts(
    pages: DataFrame, store: str, checkpoint: str, timeout: float = 3600.0, incomplete: bool = True, loader: Callable[[], Callable] | None = None, available_now: bool = True
) -> StreamingQuery:
    """``ingest_stream`` for sources whose pages arrive over several micro-batches: a source is indexed once all its
    ``total_pages`` are there, or, with ``incomplete``, once nothing of it has come for ``timeout`` seconds (without, its
    pages are dropped then). The store is the same as if all pages had come at once."""
    gathered = gathered_pages(pages, timeout)
    whole = gathered if incomplete else gathered.where("complete")
    with keyed_state(pages.sparkSession, available_now):
        return ingest_stream(whole.drop("complete"), store, checkpoint, True, loader, available_now)


def fold_answers(batch: DataFrame, key: DataFrame, path: str) -> None:
    """Takes a batch of answers (session_id, question_id, selected, ts, event_id) into the stores below ``path``:
    ``answers`` has the latest answer of each (session, question), ``scores`` a row a session. Both are in buckets by session; the
    buckets of the batch's sessions are read and rewritten, no others. Folding a batch in again changes nothing."""
    spark = batch.sparkSession
    mark = scratch_mark(spark)
    named = lambda *c: F.to_json(F.struct(*c))  # noqa: E731  null ids have a name as well
    rows = batch.select(
        named("session_id", "question_id").alias("chunk_id"), named("session_id").alias("doc_id"), "session_id", "question_id", "selected", "ts", "event_id"
    )
    rows = materialize(_latest(rows), "answers")
    if has_store(spark, f"{path}/answers"):
        rows = materialize(_latest(rows.unionByName(read_documents(spark, f"{path}/answers", rows.select("doc_id")))), "sessions")
    upsert_chunks(rows, f"{path}/answers")
    scores = score_sessions(rows, key).withColumn("chunk_id", named("session_id")).withColumn("doc_id", F.col("chunk_id"))
    upsert_chunks(scores, f"{path}/scores")
    drop_scratch(spark, mark)


def _latest(rows: DataFrame) -> DataFrame:
    own = F.struct(*rows.columns)
    return rows.groupBy("chunk_id").agg(F.max_by(own, F.struct("ts", "event_id", "selected")).alias("row")).select("row.*")


def score_stream(answers: DataFrame, key: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Running scores of sessions, read by ``read_scores``. Each micro-batch is folded into a store (``fold_answers``), which
    is the stream's state: it has one row for each (session, question), and a batch costs what its sessions' buckets hold. A reader sees
    the scores before or after a batch, never between. A session is scored with the key of the last batch that it is in."""
    out = answers.writeStream.foreachBatch(lambda batch, _: fold_answers(batch, key, path)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """session_id, answered, score, total, percent of every session so far."""
    return read_store(spark, f"{path}/scores").drop("chunk_id", "doc_id")
