"""Page filters and per-page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T


def quality_gate(pages: DataFrame, min_words: int = 40, min_letters: float = 0.4) -> DataFrame:
    """``pages`` with ``gate_reason``: ``empty``, ``low_quality`` or ``ok``. Null text is empty."""
    page = F.col("page_content")
    good = T.is_useful_page(page, min_words, min_letters)
    return pages.withColumn("gate_reason", F.when(T.is_blank(page), "empty").when(good, "ok").otherwise("low_quality"))


def useful_pages(pages: DataFrame, min_words: int = 40, min_letters: float = 0.4) -> DataFrame:
    return quality_gate(pages, min_words, min_letters).where("gate_reason = 'ok'").drop("gate_reason")


def drop_scanned(pages: DataFrame, text: str = "page_content", images: str = "n_images") -> DataFrame:
    """Pages that are images with next to no text go."""
    return pages.where(~T.is_scanned(F.col(text), F.col(images)))


def gathered(keys: Column, text: Column, by: str = "\n") -> Column:
    """Aggregate: texts in the order of ``keys`` (a struct), joined."""
    rows = F.array_sort(F.collect_list(F.struct(keys.alias("k"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), by)


def order_blocks(blocks: DataFrame, band: float = 20.0) -> DataFrame:
    """Text blocks (source, page_num, seq, y0, x0, text) to one text per page, in reading order: bands of
    ``band`` units (rounded half to even) from the top, then from the left, then as they came. A page's
    blocks meet in one row, which is what a page is."""
    some = blocks.where(~T.is_blank(F.col("text")))
    order = F.struct(F.bround(F.col("y0") / band).alias("band"), F.col("x0"), F.col("seq"))
    return some.groupBy("source", "page_num").agg(gathered(order, T.strip(F.col("text"))).alias("text"))
