"""Periodic runs of words by uniting suffix classes in the order of descending common prefixes (Kruskal's order).

A run is a stretch of words with smallest period q that is at least ``max(MIN_LENGTH, EXPONENT * q)`` long and that no
neighbouring word extends. Method, for each document: suffixes are sorted by prefix doubling; the pairs of neighbours in
that order, with their common prefix length L, are the edges of a tree over all suffixes, taken by decreasing L.
Union-find joins the classes of each edge; a class is an ordered set of positions, and the smaller one is put into the
larger. Positions i < j that become neighbours in a class so have a common prefix of exactly L words: the stretch from
i to j + L has period j - i and cannot grow at its end. It seeds a run if it cannot grow at its start either and the period
fits ``EXPONENT`` times. Every run is seeded: its start and the position one period behind become neighbours, since one
between them with as long a prefix would give a smaller period. A multiple of a run's period seeds the same stretch, of
which the smallest period counts.

A run that is long enough has a common prefix of ``MIN_PREFIX`` words one period behind its start, so shorter edges are left
out, and so is a document in which no stretch of that many words repeats.

Scale: no shuffle; texts are read where they lie, batch by batch. A document of n words takes n log n steps and some
8 log n bytes a word for the ranks. Copies are each worked out for themselves.

Edge cases: null, empty and blank texts have no words and no runs (four nulls, hashes of the empty text); a null doc_id has
no checksum, so its words stay as they are; rows that repeat are each reported; very long texts are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_LENGTH = 6
EXPONENT = 4
#: Of a run of period q one period behind its start: at least max(MIN_LENGTH, EXPONENT * q) - q words.
MIN_PREFIX = 5
Run = tuple[int, int, int]


class Positions:
    """An ordered set of positions in blocks, so that no insertion moves more than a block."""

    SIZE = 1024

    def __init__(self, at: int):
        self.blocks, self.tops, self.n = [[at]], [at], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, at: int) -> tuple[int | None, int | None]:
        """Puts ``at`` in; returns the positions just before and behind it."""
        k = min(bisect_left(self.tops, at), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, at)
        self.n += 1
        self.tops[k] = block[-1]
        spot = bisect_left(block, at)
        left = block[spot - 1] if spot else self.blocks[k - 1][-1] if k else None
        right = block[spot + 1] if spot + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        if len(block) > self.SIZE:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.tops[k : k + 1] = [block[half - 1], block[-1]]
        return left, right


def _ranks(x: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], int] | None:
    """(length, rank of each position by so many words ahead, 0 beyond the end) by doubling until all differ; None
    where no stretch of ``MIN_PREFIX`` words repeats."""
    n = len(x)

    def longer(rank: np.ndarray, by: int, more: np.ndarray) -> np.ndarray:
        ahead = np.zeros(n, np.int64)
        if by < n:
            ahead[: n - by] = more[by:]
        return np.unique(rank * (n + 2) + ahead, return_inverse=True)[1] + 1

    one = x + 1
    two = longer(one, 1, one)
    four = longer(two, 2, two)
    five = longer(four, 4, one)
    levels = [(1, one), (2, two), (4, four)]
    # Ranks of stretches cut short by the end differ from all others, so only whole stretches repeat.
    if int(five.max()) == n:
        return None
    size, rank = 4, four
    while int(rank.max()) < n:
        rank = longer(rank, size, rank)
        size *= 2
        levels.append((size, rank))
    return levels, n


def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order with a common prefix of ``MIN_PREFIX`` words or more, by decreasing length."""
    none = np.zeros(0, np.int64)
    found = _ranks(x) if len(x) >= MIN_LENGTH else None
    if found is None:
        return none, none, none
    levels, n = found
    order = np.empty(n, np.int64)
    order[levels[-1][1] - 1] = np.arange(n)
    left, right = order[:-1], order[1:]
    at, to, common = left.copy(), right.copy(), np.zeros(n - 1, np.int64)
    for size, rank in reversed(levels):
        inside = (at + size <= n) & (to + size <= n)
        same = inside.copy()
        same[inside] = rank[at[inside]] == rank[to[inside]]
        common[same] += size
        at[same] += size
        to[same] += size
    keep = np.flatnonzero(common >= MIN_PREFIX)
    keep = keep[np.argsort(-common[keep], kind="stable")]
    return left[keep], right[keep], common[keep]


def runs(x: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of the word numbers ``x`` (each below its length), by start, then period."""
    left, right, common = _edges(x)
    if not len(left):
        return []
    ids = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(ids, left).tolist(), np.searchsorted(ids, right).tolist()
    place, words = ids.tolist(), x.tolist()
    root, sets = list(range(len(place))), [None] * len(place)
    found: dict[tuple[int, int], int] = {}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for p, q, size in zip(a, b, common.tolist(), strict=True):
        p, q = find(p), find(q)
        large, small = sets[p] or Positions(place[p]), sets[q] or Positions(place[q])
        if large.n < small.n:
            p, q, large, small = q, p, small, large
        root[q], sets[p], sets[q] = p, large, None
        last = None
        for at in small:
            before, behind = large.add(at)
            # Those of the smaller set were neighbours before, with a longer prefix.
            for i, j in ((None if before == last else before, at), (at, behind)):
                if i is None or j is None:
                    continue
                period = j - i
                if (EXPONENT - 1) * period <= size and size + period >= MIN_LENGTH and (i == 0 or words[i - 1] != words[j - 1]):
                    key = (i, j + size)
                    found[key] = min(period, found.get(key, period))
            last = at
    return sorted((i, end - i, period) for (i, end), period in found.items())


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the document's checksum damages them: from some word on, one in ten repeats a stretch."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not inside]


def runs_of(words: list[bytes]) -> list[Run]:
    number: dict[bytes, int] = {}
    return runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), damaged by its checksum: doc_id, n_runs, start, length, period and
    exponent_milli of the longest run, hashes of all runs and of the words left without repetition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in REPORT.split(", ")]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = repeated((text or "").encode().split(), doc_id)  # bytes are split at ASCII white space
                found = runs_of(words)
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                out.append((len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * len(fields)
            arrays = [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *[name for name, _ in fields]])

    return docs.select("doc_id", "text").mapInArrow(report, f"doc_id {kind}, {REPORT}")
