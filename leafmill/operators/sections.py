"""Header-aware sectioning of a source's pages.

What depends on all earlier pages of a source (offsets, code fences, section numbers) is found in two levels: within
blocks of ``BLOCK_PAGES`` page numbers by a window, and over blocks by a window on one row each. A source of any
size is thus spread over as many tasks as it has blocks; pages that share a number stand in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.pages import gathered
from leafmill.session import broadcast_if_small, materialize

BLOCK_PAGES = 1024
#: Characters of a source's text that ``concat_pages`` puts in one row.
PART_CHARS = 1 << 26
#: Bytes of a source's text up to which ``whole_texts`` makes one row of it; a value in Spark ends at 2 GiB.
ROW_BYTES = 1 << 30
#: Parts of PART_CHARS that such a row has at most, and some more.
_FEW = 20
#: The source in a struct, so that a null source is a source like others in joins too.
KEYS = ("_own", "_block")


def blocked(df: DataFrame, number: Column) -> DataFrame:
    """``df`` with its source and the block of ``number`` (null is -1) as keys."""
    return df.withColumn("_own", F.struct("source")).withColumn("_block", F.coalesce(F.floor(number / BLOCK_PAGES), F.lit(-1)))


def carried(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each block the sums over the earlier blocks of its source: keys and the names of ``sums``."""
    totals = df.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy("_own").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*KEYS, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def _content() -> Column:
    return F.coalesce("page_content", F.lit(""))


def _is_fence(line: Column) -> Column:
    return T.strip(line).startswith("```")


def _placed(pages: DataFrame) -> DataFrame:
    """``pages`` with their offsets, their keys, and the characters and fences of earlier blocks."""
    keyed = blocked(pages, F.col("page"))
    size = (F.length(_content()) + 2).cast("long")
    fences = F.size(F.filter(T.lines(_content()), _is_fence))
    before = carried(keyed, {"_chars": size, "_fences": fences})
    within = Window.partitionBy(*KEYS).orderBy("page", "page_content").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("end_off", F.sum(size).over(within)).join(before, list(KEYS))
    return placed.withColumn("end_off", F.col("end_off") + F.col("_chars")).withColumn("start_off", F.col("end_off") - size)


def page_offsets(pages: DataFrame) -> DataFrame:
    """``pages`` with ``start_off`` and ``end_off`` in the source's whole text, in which every page is
    followed by two line feeds. Pages of one number are ordered by their text. No text is built."""
    return _placed(pages).drop(*KEYS, "_chars", "_fences")


def concat_pages(pages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The text of each source in rows of about ``part_chars`` characters (whole pages, so that no source is too
    large for a row): source, part (from 0), text, and its pages' bounds in the source's text (start, end, page).
    A source of up to that size is one row."""
    placed = page_offsets(pages).withColumn("part", F.floor(F.col("start_off") / part_chars).cast("int"))
    order = F.struct("page", "start_off")
    bounds = F.array_sort(F.collect_list(F.struct(F.col("start_off").alias("start"), F.col("end_off").alias("end"), "page")))
    text = gathered(order, F.concat(_content(), F.lit("\n\n")), "")
    return placed.groupBy("source", "part").agg(text.alias("text"), bounds.alias("bounds"))


def whole_texts(parts: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """The rows of ``concat_pages`` with one row a source: source, part (0), text, n_pages. A source of more than
    ``row_bytes`` bytes, which no row can hold, keeps its parts. Parts are written first and joined as they are, so that a
    task has the few parts of a source, not its pages."""
    parts = parts.select("source", "part", "text", F.size("bounds").cast("long").alias("n_pages"), F.octet_length("text").cast("long").alias("_bytes"))
    parts = materialize(parts.withColumn("_own", F.struct("source")), "text-parts")
    large = parts.groupBy("_own").agg(F.sum("_bytes").alias("_all")).where(F.col("_all") > row_bytes).select("_own")
    marked = parts.join(broadcast_if_small(materialize(large, "large-sources")).withColumn("_large", F.lit(True)), "_own", "left")
    to = marked.withColumn("_row", F.when(F.col("_large"), F.col("part")).otherwise(0))
    # Few large texts: concat makes one copy of the right length; array_join doubles a buffer, and a lambda copies what it gives.
    texts = F.sort_array(F.collect_list(F.struct("part", "text")))["text"]
    few = F.concat(*[F.coalesce(F.get(texts, F.lit(k)), F.lit("")) for k in range(_FEW)])
    joined = F.when(F.count(F.lit(1)) <= _FEW, few).otherwise(F.array_join(texts, ""))
    whole = to.groupBy("_own", "_row").agg(joined.alias("text"), F.sum("n_pages").alias("n_pages"))
    return whole.select(F.col("_own.source").alias("source"), F.col("_row").alias("part"), "text", "n_pages")


#: The order of a source's lines; pages of one number one after the other.
_LINE = ("page", "start_off", "line_no")


def _tagged(pages: DataFrame) -> DataFrame:
    placed = _placed(pages)
    rows = placed.select(*KEYS, "source", "page", "start_off", "_chars", "_fences", F.posexplode(F.concat(T.lines(_content()), F.array(F.lit("")))).alias("line_no", "line"))
    order = Window.partitionBy(*KEYS).orderBy(*_LINE)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fence = _is_fence(F.col("line"))
    size = (F.length("line") + 1).cast("long")
    inside = (F.col("_fences") + F.sum(fence.cast("int")).over(upto)) % 2 == 1
    off = F.col("_chars") + F.sum(size).over(upto) - size
    level = F.length(F.regexp_extract("line", r"\A(#{1,3})( [^\n]*)?\z", 1))
    return rows.withColumn("off", off).withColumn("level", F.when(inside | fence, 0).otherwise(level)).drop("_chars", "_fences")


def tag_heading_lines(pages: DataFrame) -> DataFrame:
    """One row per line: source, page, line_no, off (in the source's text), line, level (0: no heading).
    Lines inside a code fence are no headings."""
    return _tagged(pages).drop(*KEYS, "start_off")


def split_by_headers(pages: DataFrame) -> DataFrame:
    """Sections: source, section_seq, section, subsection, subsubsection, text, start_off, end_off. A new
    section begins at each heading, which stays in its text; a heading clears the deeper ones. A section is one
    row; of a source only its headings, a short row each, meet in a task."""
    tagged = _tagged(pages)
    heading = (F.col("level") > 0).cast("int")
    upto = Window.partitionBy(*KEYS).orderBy(*_LINE).rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.withColumn("_n", F.sum(heading).over(upto)).join(carried(tagged, {"_heads": heading}), list(KEYS))
    rows = rows.withColumn("section_seq", F.col("_n") + F.col("_heads"))
    name = F.nullif(T.strip(F.regexp_replace("line", r"\A#{1,3}", "")), F.lit(""))
    is_head = F.col("level") > 0
    pieces = rows.groupBy(*KEYS, "section_seq").agg(
        gathered(F.struct(*_LINE), F.col("line")).alias("text"), F.max("level").alias("level"), F.max(F.when(is_head, name)).alias("name"),
        F.min("off").alias("start_off"), F.max(F.col("off") + F.length("line")).alias("end_off"),
    )
    whole = pieces.groupBy("_own", "section_seq").agg(
        gathered(F.struct("_block"), F.col("text")).alias("text"), F.max("level").alias("level"), F.max("name").alias("name"),
        F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"),
    )
    whole = materialize(whole.withColumn("text", T.strip(F.col("text"))), "sections")

    order = Window.partitionBy("_own").orderBy("section_seq").rowsBetween(Window.unboundedPreceding, 0)
    heads = whole.select("_own", "section_seq", "level", "name")
    for level in (1, 2):
        heads = heads.withColumn(f"r{level}", F.sum(F.col("level").between(1, level).cast("int")).over(order))
    last = lambda level, *keys: F.last(F.when(F.col("level") == level, F.col("name")), ignorenulls=True).over(
        Window.partitionBy("_own", *keys).orderBy("section_seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    heads = heads.withColumn("section", last(1)).withColumn("subsection", last(2, "r1")).withColumn("subsubsection", last(3, "r2"))
    named = whole.where("text <> ''").join(heads.drop("level", "name", "r1", "r2"), ["_own", "section_seq"])
    return named.select(F.col("_own.source").alias("source"), "section_seq", "section", "subsection", "subsubsection", "text", "start_off", "end_off")


def with_breadcrumb(sections: DataFrame) -> DataFrame:
    """Sections whose text begins with the path of their headings."""
    path = T.build_breadcrumb(F.col("section"), F.col("subsection"), F.col("subsubsection"))
    return sections.withColumn("breadcrumb", path).withColumn("text", T.inject_breadcrumb(F.col("text"), F.col("breadcrumb")))
