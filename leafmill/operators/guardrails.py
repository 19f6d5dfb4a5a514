"""Chunk size guardrails: an ordered fold over each source's pieces, and chunk assembly.

A piece of ``min_size`` characters or more always closes the fold's buffer, so the fold begins anew behind it. A
source is therefore cut, without any change to the result, into runs of short pieces with the long one that ends
them, and each run is folded by itself. Runs are numbered, and chunks within a source, in two levels (blocks, and one
row a block). The runs of a block are read as a stream: a task holds the open buffer and the last chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.sentences import sentences
from leafmill.operators.sections import BLOCK_PAGES, KEYS, blocked, carried, page_offsets, split_by_headers
from leafmill.operators.semantic import semantic_split
from leafmill.session import drop_materialized, materialize

MIN_SIZE, MAX_SIZE = 100, 1000

#: A piece or chunk: text, start_off, end_off, headings (section, subsection, subsubsection).
Piece = tuple[str, int, int, tuple]


def merge_undersized(pieces: Iterable[Piece], min_size: int = MIN_SIZE, max_size: int = MAX_SIZE) -> Iterator[Piece]:
    """Short pieces join the next one while both fit; a short rest joins the last chunk if it fits."""
    last: Piece | None = None
    buf: Piece | None = None
    for piece in pieces:
        if buf is None:
            buf = piece
        elif len(buf[0]) + 1 + len(piece[0]) <= max_size:
            buf = (f"{buf[0]} {piece[0]}", buf[1], piece[2], buf[3])
        else:
            if last is not None:
                yield last
            last, buf = buf, piece
        if len(buf[0]) >= min_size:
            if last is not None:
                yield last
            last, buf = buf, None
    if buf is not None:
        if last is not None and len(last[0]) + len(buf[0]) + 1 <= max_size:
            last = (f"{last[0]} {buf[0]}", last[1], buf[2], last[3])
        else:
            if last is not None:
                yield last
            last = buf
    if last is not None:
        yield last


def split_oversized(chunks: Iterable[Piece], max_size: int = MAX_SIZE) -> Iterator[Piece]:
    """Longer chunks are packed anew, sentence by sentence; one longer sentence stays whole."""
    for text, start, end, meta in chunks:
        if len(text) <= max_size:
            yield text, start, end, meta
            continue
        buf, used = "", 0
        for s in sentences(text):
            joined = f"{buf} {s}".strip()
            if buf and len(joined) > max_size:
                yield buf, min(end, start + used), min(end, start + used + len(buf)), meta
                used += len(buf) + 1
                joined = s
            buf = joined
        if buf:
            yield buf, min(end, start + used), end, meta


def apply_size_guardrails(pieces: Iterable[Piece], min_size: int | None = MIN_SIZE, max_size: int | None = MAX_SIZE) -> Iterator[Piece]:
    min_size, max_size = min_size or MIN_SIZE, max_size or MAX_SIZE
    return split_oversized(merge_undersized(pieces, min_size, max_size), max_size)


_SCHEMA = "source string, block long, place int, text string, start_off long, end_off long, section string, subsection string, subsubsection string"
_NAMES = [x.strip().split()[0] for x in _SCHEMA.split(",")]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
_HEADINGS = ["section", "subsection", "subsubsection"]


def _numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """Keyed ``rows`` with their place within the source, from 0."""
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(carried(rows, {"_rows": F.lit(1)}), list(KEYS)).withColumn(number, (F.col("_place") + F.col("_rows")).cast("int")).drop("_place", "_rows")


def fold_chunks(pieces: DataFrame, min_size: int | None = MIN_SIZE, max_size: int | None = MAX_SIZE, compat_index_meta: bool = False) -> DataFrame:
    """``pieces``: source, section_seq, part, text, start_off, end_off, headings. One row per chunk with
    its index within the source. A chunk has the headings of its first piece, or, with
    ``compat_index_meta``, those of the piece with the chunk's own index (the last one beyond)."""
    min_size, max_size = min_size or MIN_SIZE, max_size or MAX_SIZE
    order = ["section_seq", "part"]
    keyed = blocked(pieces, F.col("section_seq"))
    long = (F.length("text") >= min_size).cast("int")
    before = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Short pieces behind the last long one may join its chunk, so they belong to its run. All that a piece needs of
    # other blocks comes in one row for each block, so that texts stay where the window has them.
    per = keyed.groupBy(*KEYS).agg(F.sum(long).cast("long").alias("_n"))
    own = Window.partitionBy("_own")
    earlier = F.sum("_n").over(own.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = per.select(*KEYS, F.coalesce(earlier, F.lit(0)).alias("_longs"), F.greatest(F.sum("_n").over(own) - 1, F.lit(0)).alias("_last"))
    runs = keyed.withColumn("_long", F.coalesce(F.sum(long).over(before), F.lit(0))).join(blocks, list(KEYS))
    runs = runs.withColumn("run", F.least(F.col("_long") + F.col("_longs"), F.col("_last")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for (source, block), own in groupby(rows, key=lambda r: (r[0], r[1] // BLOCK_PAGES)):
            place = 0  # within the block's chunks
            for _, of_run in groupby(own, key=lambda r: r[1]):
                own_pieces = ((r[5], r[6], r[7], r[2:5]) for r in of_run)
                for text, start, end, meta in apply_size_guardrails(own_pieces, min_size, max_size):
                    out.append((source, block, place, text, start, end, *meta))
                    place += 1
                    if len(out) >= 1000:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    columns = ["source", "run", *_HEADINGS, "text", "start_off", "end_off"]
    dealt = blocked(runs, F.col("run")).repartition("source", "_block").sortWithinPartitions("source", "run", *order).select(*columns)
    folded = materialize(dealt.mapInArrow(fold, _SCHEMA), "folded")
    folded = folded.withColumn("_own", F.struct("source")).withColumnRenamed("block", "_block")
    # A source's first block begins at 0; only later ones ask how many chunks are before them.
    first, later = folded.where("_block = 0").withColumn("chunk_index", F.col("place")), folded.where("_block > 0")
    later = later.join(carried(folded, {"_rows": F.lit(1)}).where("_block > 0"), list(KEYS))
    later = later.withColumn("chunk_index", (F.col("place") + F.col("_rows")).cast("int"))
    chunks = first.unionByName(later.select(*first.columns))
    if compat_index_meta:
        placed = _numbered(keyed, order, "_index").select("_own", "_index", *_HEADINGS)
        n = placed.groupBy("_own").agg((F.count(F.lit(1)) - 1).cast("int").alias("_most"))
        chunks = chunks.drop(*_HEADINGS).join(n, "_own").withColumn("_index", F.least("chunk_index", "_most")).join(placed, ["_own", "_index"])
    return chunks.select("source", "chunk_index", "text", "start_off", "end_off", *_HEADINGS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def page_span(chunks: DataFrame, pages: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Adds page_start (the page that holds start_off) and page_end (the page with start < end_off <= end;
    the source's last one beyond its end). A range join: page bounds are listed under every stretch of
    ``width`` characters that they touch, positions under theirs, so a source of many pages is spread over
    as many keys."""
    bounds = page_offsets(pages).select("source", F.col("page").cast("int").alias("at"), F.col("start_off").alias("s"), F.col("end_off").alias("e"))
    stretch = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))
    listed = bounds.select("*", stretch.alias("stretch"))
    total = bounds.groupBy("source").agg(F.max("e").alias("total"))
    own = chunks.select("source", "chunk_index", "start_off", "end_off").join(total, "source")
    last = F.greatest(F.least(F.col("end_off"), F.col("total")) - 1, F.lit(0))
    place = lambda first, pos: F.struct(F.lit(first).alias("first"), pos.alias("pos"))
    looked = own.select("source", "chunk_index", F.inline(F.array(place(True, F.col("start_off")), place(False, last))))
    looked = looked.withColumn("stretch", F.floor(F.col("pos") / width))
    found = looked.join(listed, ["source", "stretch"]).where("s <= pos AND pos < e")
    spans = found.groupBy("source", "chunk_index").agg(
        F.max(F.when(F.col("first"), F.col("at"))).alias("page_start"), F.max(F.when(~F.col("first"), F.col("at"))).alias("page_end")
    )
    return chunks.join(spans, ["source", "chunk_index"], "left")


def chunk_documents(
    pages: DataFrame,
    k: float | None = 1.5,
    min_size: int | None = MIN_SIZE,
    max_size: int | None = MAX_SIZE,
    loader: Callable[[], Callable] | None = None,
    compat_index_meta: bool = False,
) -> DataFrame:
    """Pages (source, page, page_content) to chunks: chunk_id, source, chunk_index, text, page_start,
    page_end, headings, num_sentences, char_count. Pages and the parts of sections are read more than once, so both
    are written to the shared folder first; what no later step reads is removed on the way."""
    pages = materialize(pages.select("source", "page", "page_content"), "pages")
    sections = split_by_headers(pages)
    parts = semantic_split(sections, max_size, k, loader)
    path = T.build_breadcrumb(F.col("section"), F.col("subsection"), F.col("subsubsection"))
    # A section carries its path on each of its parts, before sizes are looked at.
    parts = materialize(parts.withColumn("text", T.inject_breadcrumb(F.col("text"), path)), "parts")
    drop_materialized(sections)
    folded = fold_chunks(parts, min_size, max_size, compat_index_meta)
    if not compat_index_meta:
        drop_materialized(parts)  # only the headings of other pieces are looked up there later
    chunks = page_span(folded, pages)
    return chunks.select(
        T.chunk_id(F.col("source"), F.col("chunk_index")).alias("chunk_id"),
        "source", "chunk_index", "text", "page_start", "page_end", "section", "subsection", "subsubsection",
        T.num_sentences(F.col("text")).alias("num_sentences"),
        F.length("text").alias("char_count"),
    )


def recursive_token_split(text: str, max_tokens: int = 512, overlap: int = 50, count: Callable[[str], int] | None = None) -> list[str]:
    """Splits at blank lines, lines, sentences, words, characters in turn until pieces hold at most ``max_tokens``.
    Each piece after the first begins with the last words of the one before, ``overlap`` of them or as many as
    fit: they count to its ``max_tokens``."""
    count = count or (lambda s: len(s.split()))
    if count(text) <= max_tokens:
        return [text] if text.strip() else []
    own: list[str] = []

    def room() -> int:
        return max(1, max_tokens - overlap) if own else max_tokens

    def pack(parts: Sequence[str], mark: str, marks: tuple[str, ...]) -> None:
        """As many neighbouring parts in a piece as there is room for; how many is found by doubling and halving."""
        at = 0
        while at < len(parts):
            fits = lambda n: count(mark.join(parts[at : at + n])) <= room()  # noqa: B023, E731
            good, step = 0, 1
            while good + step <= len(parts) - at and fits(good + step):
                good, step = good + step, 2 * step
            while step := step // 2:
                if good + step <= len(parts) - at and fits(good + step):
                    good += step
            if good or not mark:
                if (piece := mark.join(parts[at : at + max(1, good)])).strip():
                    own.append(piece)
            else:
                pack(parts[at].split(marks[0]) if marks[0] else parts[at], marks[0], marks[1:])
            at += max(1, good)

    pack(text.split("\n\n"), "\n\n", ("\n", ". ", " ", ""))
    out = own[:1]
    for before, piece in zip(own, own[1:], strict=False):
        words = before.split()[-overlap:] if overlap else []
        low, high = 0, len(words)  # words left out
        while low < high:
            drop = (low + high) // 2
            low, high = (low, drop) if count(f"{' '.join(words[drop:])} {piece}") <= max_tokens else (drop + 1, high)
        out.append(f"{' '.join(words[low:])} {piece}" if words[low:] else piece)
    return out


def token_split(df: DataFrame, column: str = "text", max_tokens: int = 512, overlap: int = 50, counter: Callable[[str], int] | None = None) -> DataFrame:
    """``df`` with one row per piece of ``column``; adds ``piece`` (from 0), other columns are kept."""
    names, at = [*df.columns, "piece"], df.columns.index(column)
    schema = df.withColumn("piece", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [recursive_token_split(t or "", max_tokens, overlap, counter) for t in batch.column(at).to_pylist()]
            rows = pa.array([k for k, p in enumerate(pieces) for _ in p], pa.int64())
            cols = [c.take(rows) for c in batch.columns]
            cols[at] = pa.array([x for p in pieces for x in p], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for p in pieces for n in range(len(p))], pa.int32())], names)

    return df.mapInArrow(run, schema)


def token_gate(chunks: DataFrame, least: int = 30, most: int = 512) -> DataFrame:
    """Adds token_count and ``oversize``; chunks under ``least`` tokens go."""
    n = F.size(T.tokens(F.col("text")))
    return chunks.withColumn("token_count", n).where(F.col("token_count") >= least).withColumn("oversize", F.col("token_count") > most)


def enriched_chunk(chunks: DataFrame) -> DataFrame:
    """raw_text next to the text with its path, token_count, and an id ``source:p{page}:c{index}``."""
    path = T.build_breadcrumb(F.col("section"), F.col("subsection"), F.col("subsubsection"))
    ident = F.concat_ws("", F.col("source"), F.lit(":p"), F.col("page_start").cast("string"), F.lit(":c"), F.col("chunk_index").cast("string"))
    return chunks.select(
        ident.alias("id"), "source", "chunk_index", "page_start", F.col("text").alias("raw_text"),
        T.inject_breadcrumb(F.col("text"), path).alias("text"), F.size(T.tokens(F.col("text"))).alias("token_count"),
    )
