"""Exact dedup through counting quotient filters.

A fingerprint is the leading bits of a 64-bit hash of the normalised text. Its top bits name a *shelf*; within
a shelf the next bits are the quotient, the home slot, and the rest the remainder. Each partition builds a
counting quotient filter a shelf: remainders lie in slots by linear probing, those of one quotient in a run,
in ascending order. Three marks are kept, one bit each: ``occupied`` (a quotient has a run), ``ends`` (a slot
is the last of its run), ``digits`` (a slot holds a digit of the count of the remainder before it, as only
counts above one take such slots). Quotients are not stored: the k-th run belongs to the k-th occupied one.
The number of quotient bits follows the entries of the filter, and the remainder takes the bits that are
left, so that filters of any size hold the same fingerprints and merge without loss: the sorted remainders of
a shelf are read as a stream, and the counts of equal ones add up. Only fingerprints with a count above one
go on to byte verification, which groups candidates by their whole normalised text.

Scale: a copy group of any size is one (fingerprint, count) entry per partition, so a hot text costs one entry
per partition in the filter and one partially aggregated row per partition in verification. When verdicts
return to rows, that is a plain equi-join, which adaptive execution splits. A merging task reads its filters
in the order of their shelves and holds one shelf's distinct fingerprints; the number of shelves is a power of
two chosen from the row count.

Edge cases: null text counts as empty, and all empty texts are copies of one another; very long texts are
hashed and compared whole; null doc_id sorts after every other id (a group of only null ids keeps them all,
with keep_id null); rows that repeat one doc_id with one text are the same document and share its verdict,
while a repeated doc_id with another text is judged by that text; an empty table gives an empty result; other
columns of the input are ignored whatever their names. ``deduplicated`` leaves one row of every group, also
where ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.rows import keep_one, row_hash
from leafmill.llm.textnorm import one_space
from leafmill.session import broadcast_if_small, materialize

#: Remainder bits of a full filter: with r bits a text shares another one's fingerprint with probability under 2**-r.
R_BITS = 24
#: Entries a shelf should hold on average, and the share of slots that may be in use.
SHELF_ENTRIES = 8192
LOAD = 0.9

FILTER_SCHEMA = "shelf long, q_bits int, r_bits int, occupied binary, ends binary, digits binary, remainders binary"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in FILTER_SCHEMA.split(", ")]


def encode(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple:
    """A filter of sorted distinct ``keys`` of ``bits`` bits with their counts: the columns after the shelf."""
    q_bits = min(bits, max(0, int(np.ceil(np.log2(max(1, len(keys)) / LOAD)))))
    r_bits = bits - q_bits
    width = max(1, -(-r_bits // 8))  # bytes of a slot
    quotient = (keys >> np.uint64(r_bits)).astype(np.int64) if r_bits < 64 else np.zeros(len(keys), np.int64)
    remainder = keys & np.uint64((1 << r_bits) - 1)
    more = counts.astype(np.uint64) - np.uint64(1)
    n_digits = np.zeros(len(keys), np.int64)
    left = more.copy()
    while left.any():
        n_digits += left > 0
        left >>= np.uint64(8 * width) if width < 8 else np.uint64(63)
    # A run begins in its quotient's slot, or where the run before it ends.
    used = 1 + n_digits
    before = np.cumsum(used) - used
    slot = np.maximum.accumulate(quotient - before) + before if len(keys) else quotient
    slots = max(1 << q_bits, int(slot[-1] + used[-1]) if len(keys) else 0)
    occupied, ends, digits = np.zeros(1 << q_bits, bool), np.zeros(slots, bool), np.zeros(slots, bool)
    occupied[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)[: len(keys)]
    ends[(slot + used - 1)[last]] = True
    values = np.zeros(slots, np.uint64)
    values[slot] = remainder
    for k in range(int(n_digits.max(initial=0))):
        own = n_digits > k
        digits[slot[own] + 1 + k] = True
        values[slot[own] + 1 + k] = (more[own] >> np.uint64(8 * width * k)) & np.uint64((1 << 8 * width) - 1)
    packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return q_bits, r_bits, *(np.packbits(x, bitorder="little").tobytes() for x in (occupied, ends, digits)), packed


def decode(q_bits: int, r_bits: int, occupied: bytes, ends: bytes, digits: bytes, remainders: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a filter."""
    width = max(1, -(-r_bits // 8))
    slots = len(remainders) // width
    values = np.zeros((slots, 8), np.uint8)
    values[:, :width] = np.frombuffer(remainders, np.uint8).reshape(-1, width)
    values = values.reshape(-1).view("<u8").astype(np.uint64)
    bit = lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)
    quotient, end, digit = np.flatnonzero(bit(occupied, 1 << q_bits)), np.flatnonzero(bit(ends, slots)), bit(digits, slots)
    if not len(end):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.maximum(quotient, np.append(-1, end[:-1]) + 1)
    size = end - start + 1
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    run = np.repeat(quotient, size)
    first = ~digit[at]
    high = run[first].astype(np.uint64) << np.uint64(r_bits) if r_bits < 64 else np.uint64(0)
    owner = np.cumsum(first) - 1
    place = np.arange(len(at)) - np.flatnonzero(first)[owner] - 1
    extra = np.zeros(int(first.sum()), np.uint64)
    more = ~first
    np.add.at(extra, owner[more], values[at[more]] << (place[more] * 8 * width).astype(np.uint64))
    return high | values[at[first]], (extra + np.uint64(1)).astype(np.int64)


def merge_sorted(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray):
    """Lossless merge of two sorted lists: keys stay sorted, counts of equal ones add up."""
    both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, at, np.concatenate([counts, more_counts]))
    return both, total


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


def entries(row: dict, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Whole fingerprints of ``bits`` bits and their counts from one filter row."""
    keys, counts = decode(*(row[c] for c in _NAMES[1:]))
    inner = row["q_bits"] + row["r_bits"]
    return (keys | (np.uint64(row["shelf"]) << np.uint64(inner)) if inner < bits else keys), counts


def build_filters(fingerprints: DataFrame, shelf_bits: int, bits: int = 64, flush: int = 1_000_000) -> DataFrame:
    """A counting quotient filter per partition of ``fingerprints`` (one long column ``fp`` of ``bits`` bits), as
    one row per shelf. At most ``flush`` distinct fingerprints are held before rows are emitted."""
    inner = bits - shelf_bits

    def emit(fps: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        shelves = (fps >> np.uint64(inner)) if inner < 64 else np.zeros(len(fps), np.uint64)
        keys = fps & np.uint64((1 << inner) - 1)
        starts = np.flatnonzero(np.r_[True, shelves[1:] != shelves[:-1]]) if len(fps) else []
        ends = np.r_[starts[1:], len(fps)] if len(fps) else []
        for k in range(0, len(starts), 512):
            yield _rows([(int(shelves[a]), *encode(keys[a:b], counts[a:b], inner)) for a, b in zip(starts[k : k + 512], ends[k : k + 512], strict=True)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True)
            fps, counts = merge_sorted(fps, counts, new, n)
            if len(fps) > flush:
                yield from emit(fps, counts)
                fps, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from emit(fps, counts)

    return fingerprints.mapInArrow(build, FILTER_SCHEMA)


def merge_filters(filters: DataFrame) -> DataFrame:
    """One merged filter row per shelf. A task streams its filters shelf by shelf and holds the distinct
    fingerprints of one shelf, however many copies a fingerprint has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, inner = None, 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> None:
            nonlocal keys, counts, held, size
            if held:
                keys, counts = merge_sorted(keys, counts, np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if row["shelf"] != shelf:
                    fold()
                    if shelf is not None:
                        yield _rows([(shelf, *encode(keys, counts, inner))])
                    shelf, inner = row["shelf"], row["q_bits"] + row["r_bits"]
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                own = decode(*(row[c] for c in _NAMES[1:]))
                held.append(own)
                size += len(own[0])
                if size > max(SHELF_ENTRIES, len(keys)):
                    fold()
        fold()
        if shelf is not None:
            yield _rows([(shelf, *encode(keys, counts, inner))])

    return filters.repartition("shelf").sortWithinPartitions("shelf").mapInArrow(merge, FILTER_SCHEMA)


def counted_above(filters: DataFrame, least: int = 1, bits: int = 64) -> DataFrame:
    """Fingerprints (column ``fp``) whose count in the merged filter is above ``least``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fps, counts = entries(row, bits)
                yield pa.RecordBatch.from_arrays([pa.array(fps[counts > least].view(np.int64))], ["fp"])

    return filters.mapInArrow(pick, "fp long")


def filter_bits(rows: int) -> tuple[int, int]:
    """Shelf bits and fingerprint bits for so many rows."""
    shelf = min(40, max(0, (rows // SHELF_ENTRIES).bit_length()))
    return shelf, min(64, max(rows, 1).bit_length() + R_BITS)


def _candidates(docs: DataFrame, *more: str) -> DataFrame:
    """norm and ``more`` of the rows whose fingerprint the filters count more than once."""
    shelf_bits, bits = filter_bits(docs.count())
    norm = one_space(F.col("text"))
    fp = F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits)
    source = docs.select(*more, norm.alias("norm")).withColumn("fp", fp)
    filters = merge_filters(build_filters(source.select("fp"), shelf_bits, bits))
    repeated = materialize(counted_above(filters, bits=bits), "repeated")
    return source.join(broadcast_if_small(repeated), "fp", "left_semi").drop("fp")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of two or more equal documents: text_sha256, keep_id, group_size."""
    return (
        _candidates(docs, "doc_id")
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", F.sha2(one_space(F.col("text")), 256).alias("text_sha256"))
    return rows.join(exact_groups(docs), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each group of equal texts: that of smallest doc_id,
    null last."""
    keyed = docs.select(F.col("doc_id"), F.col("text"), row_hash(docs).alias("row_hash"))
    rows = _candidates(keyed, "doc_id", "row_hash").select("doc_id", "row_hash", F.sha2("norm", 256).alias("grp"))
    rows = materialize(rows, "candidates")
    grown = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    return keep_one(docs, rows.join(broadcast_if_small(materialize(grown, "grown")), "grp", "left_semi"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, min(doc_id) OVER w IS NULL) AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
