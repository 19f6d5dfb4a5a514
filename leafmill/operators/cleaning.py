"""Corpus-wide boilerplate detection and page cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import broadcast_if_small, materialize

#: Characters of header lines, of all sources together, up to which they are sent to every task.
SENT = 4_000_000


def detect_repeating_lines(
    pages: DataFrame, threshold: float = 0.5, scope: str = "source", min_occurrences_floor: int = 1, edge: int = 3
) -> DataFrame:
    """Lines that stand among the first or last ``edge`` lines of at least ``int(pages * threshold)`` pages
    of a source (``scope="source"``) or of all pages (``scope="all"``): source (null for all), line, n.
    Sources with fewer than three pages have none.

    Pages are counted first, without their texts; lines are looked at only where a source has pages enough. One shuffle of
    at most six lines a page, aggregated on the map side: a line that is on most pages is one row per task."""
    key = F.col("source") if scope == "source" else F.lit(None).cast("string").alias("source")
    total = pages.select(key).groupBy("source").agg(F.count(F.lit(1)).alias("total")).where("total >= 3").withColumnRenamed("source", "s")
    total = broadcast_if_small(materialize(total, "totals"))
    page = pages.select(key, F.filter(F.transform(T.lines(T.strip(F.col("page_content"))), T.strip), lambda x: x != "").alias("rows"))
    edges = F.concat(F.slice("rows", 1, edge), F.slice("rows", F.greatest(F.lit(1), F.size("rows") - edge + 1), edge))
    kept = F.array_distinct(F.filter(F.transform(edges, F.lower), lambda x: F.length(x) > 3))
    lines = page.join(total, F.col("source").eqNullSafe(F.col("s"))).select("source", "total", F.explode(kept).alias("line"))
    counts = lines.groupBy("source", "total", "line").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.floor(F.col("total") * threshold), F.lit(min_occurrences_floor))
    return counts.where(F.col("n") >= need).select("source", "line", "n")


def strip_known_headers(pages: DataFrame, headers: DataFrame, scope: str = "source", sent: int = SENT) -> DataFrame:
    """Drops every line of a page that is, stripped and lower-cased, one of its scope's ``headers``
    (source, line), which are written first. Up to ``sent`` characters of them are broadcast, one row a source.

    Of more, no set is made: the lines of the pages, exploded, meet the headers in an equi-join, and what is
    found goes back to the pages by their texts' hash, so that a row never holds more lines than its page has. Lines stay in their place, pages
    with equal texts in one scope share what is found, and adaptive execution splits a line that many pages have."""
    own = F.lit(None).cast("string") if scope == "all" else F.col("source")
    headers = materialize(headers.where("line IS NOT NULL").select(own.alias("_s"), F.col("line").alias("_line")).distinct(), "headers")
    size = headers.agg(F.sum(F.length("_line") + F.coalesce(F.length("_s"), F.lit(0)) + 16)).first()[0] or 0
    line = lambda x: F.lower(T.strip(x))
    text = F.col("page_content")
    if size <= sent:
        sets = F.broadcast(headers.groupBy("_s").agg(F.collect_list("_line").alias("_known")))
        joined = pages.join(sets, own.eqNullSafe(F.col("_s")), "left").drop("_s")
    else:
        lines = pages.select(own.alias("_o"), F.sha2(text, 256).alias("_t"), F.explode(F.array_distinct(F.transform(T.lines(text), line))).alias("_l"))
        met = lines.join(headers, F.col("_o").eqNullSafe(F.col("_s")) & (F.col("_l") == F.col("_line")))
        found = met.groupBy("_o", "_t").agg(F.collect_set("_l").alias("_known"))
        joined = pages.join(found, own.eqNullSafe(F.col("_o")) & (F.sha2(text, 256) == F.col("_t")), "left").drop("_o", "_t")
    known = F.coalesce(F.col("_known"), F.array().cast("array<string>"))
    left = F.filter(T.lines(text), lambda x: ~F.array_contains(known, line(x)))
    return joined.withColumn("page_content", F.array_join(left, "\n")).drop("_known")


def clean_pages(
    pages: DataFrame,
    threshold: float = 0.5,
    scope: str = "source",
    hyphens: bool = True,
    headers: bool = True,
    page_numbers: bool = True,
    whitespace: bool = True,
) -> DataFrame:
    """Running headers are found in the raw texts; then hyphens, control characters, headers, page
    numbers and white space are dealt with in this order, and blank pages go. Control characters are
    always removed."""
    found = detect_repeating_lines(pages, threshold, scope) if headers else None
    text = F.col("page_content")
    names = pages.columns
    out = pages.withColumn("page_content", T.strip_control(T.rejoin_hyphens(text) if hyphens else text))
    if found is not None:
        out = strip_known_headers(out, found, scope)
    if page_numbers:
        out = out.withColumn("page_content", T.strip_page_numbers(text))
    if whitespace:
        out = out.withColumn("page_content", T.normalize_whitespace(text))
    # As a generated row the cleaned text is worked out once; a filter would be moved below it, with the whole cleaning inside.
    kept = F.explode(F.filter(F.array(text), lambda x: ~T.is_blank(x))).alias("page_content")
    return out.select(*[kept if c == "page_content" else F.col(f"`{c}`") for c in names])
