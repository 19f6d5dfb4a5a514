"""Scores and statistics of every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.pages import quality_gate


def score_sessions(answers: DataFrame, key: DataFrame) -> DataFrame:
    """``answers``: session_id, question_id, selected, ts, event_id; ``key``: question_id, correct. The
    latest answer to a question counts; questions without one count as wrong. Percent is rounded half up.
    The number of questions is the only value that is not grouped; it is a one-row join."""
    latest = answers.groupBy("session_id", "question_id").agg(F.max_by("selected", F.struct("ts", "event_id")).alias("selected"))
    scored = latest.join(key, "question_id").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("answered"), F.count_if(F.col("selected") == F.col("correct")).alias("score")
    )
    total = F.broadcast(key.agg(F.count(F.lit(1)).alias("total")))  # one row
    joined = scored.join(total, F.lit(True))
    return joined.withColumn("percent", F.round(100 * F.col("score") / F.col("total")).cast("int"))


def load_report(pages: DataFrame) -> DataFrame:
    """Per source and in all (source null): sources, pages, kept, empty, low_quality, chars."""
    gated = quality_gate(pages).withColumn("chars", F.length(F.coalesce("page_content", F.lit(""))).cast("long"))
    is_ = lambda r: F.count_if(F.col("gate_reason") == r)
    return gated.rollup("source").agg(
        F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("pages"), is_("ok").alias("kept"), is_("empty").alias("empty"),
        is_("low_quality").alias("low_quality"), F.sum("chars").alias("chars"),
    )


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: pages, kept, chars_before, chars_after, reduction (percent, two places)."""
    size = F.coalesce(F.sum(F.length("page_content").cast("long")), F.lit(0))
    a = before.agg(F.count(F.lit(1)).alias("pages"), size.alias("chars_before"))
    b = after.agg(F.count(F.lit(1)).alias("kept"), size.alias("chars_after"))
    cut = F.when(F.col("chars_before") > 0, F.round((1 - F.col("chars_after") / F.col("chars_before")) * 100, 2)).otherwise(0.0)
    return a.join(F.broadcast(b), F.lit(True)).withColumn("reduction", cut)  # one row each


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Per source and in all: chunks, min_chars, avg_chars (whole part), max_chars."""
    size = F.length("text")
    return chunks.rollup("source").agg(
        F.count(F.lit(1)).alias("chunks"), F.min(size).alias("min_chars"), F.avg(size).cast("int").alias("avg_chars"), F.max(size).alias("max_chars")
    )


def collection_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, metric, dimension, sources, sample_sources (the first five at most)."""
    per = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
    first = per.where("source IS NOT NULL").select("source").orderBy("source").limit(5)
    names = first.agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sample_sources"))
    stats = per.agg(F.sum("n").alias("chunks"), F.max("d").alias("dimension"), F.count("source").alias("sources"))
    return stats.join(F.broadcast(names), F.lit(True)).withColumn("metric", F.lit("cosine"))  # one row each


def ingest_report(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: pages, chunks, status (``indexed``, or ``failed`` without a chunk)."""
    p = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    c = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    joined = p.join(c, "source", "full_outer").select("source", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return joined.withColumn("doc_id", T.attach_doc_id(F.col("source"))).withColumn("status", F.when(F.col("chunks") > 0, "indexed").otherwise("failed"))


def validation_report(validated: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Replies by attempt and error (``ok`` without one), with all subtotals: attempt, error, n."""
    tried = validated.where(F.col("attempt") <= max_attempts).withColumn("error", F.coalesce("error", F.lit("ok")))
    return tried.cube("attempt", "error").agg(F.count(F.lit(1)).alias("n"))


def token_report(chunks: DataFrame, by: str = "source") -> DataFrame:
    """Per document: chunks, min, whole part of the mean, and max of the token count; null text has none."""
    n = F.size(T.tokens(F.coalesce("text", F.lit(""))))
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("chunks"), F.min(n).alias("min_tokens"), F.avg(n).cast("int").alias("avg_tokens"), F.max(n).alias("max_tokens")
    )
