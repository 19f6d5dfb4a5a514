"""Vectorised word and shingle hashes of whole texts.

A word's hash is a polynomial of its UTF-8 bytes modulo 2**64, taken as a difference of prefix sums,
then mixed. Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Work is done
in segments of bounded length that end at white space, so a long text needs no more memory than a short
one beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
SEGMENT = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[base] = have = np.multiply.accumulate(table)
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def _segment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one segment."""
    b = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    terms = (_LOWER[b].astype(np.uint64) + np.uint64(1)) * _power(_P, len(b))[: len(b)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return starts, mix64((sums[ends] - sums[starts]) * _power(_P_INV, len(b) + 1)[starts])


def _cut(raw: bytes) -> Iterator[bytes]:
    """Pieces of about SEGMENT bytes that end at white space (a longer word stays whole)."""
    at = 0
    while len(raw) - at > SEGMENT:
        stop = max(raw.rfind(c, at + 1, at + SEGMENT) for c in (b" ", b"\n", b"\t"))
        if stop <= at:
            found = [k for c in (b" ", b"\n", b"\t") if (k := raw.find(c, at + SEGMENT)) >= 0]
            stop = min(found, default=len(raw))
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Yields (index of the first text, arrays of word hashes in order) for runs of texts."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size + len(raw) > SEGMENT and held:
            yield first, _run(held)
            first, held, size = k, [], 0
        if len(raw) > SEGMENT:
            yield k, [np.concatenate([_segment(x)[1] for x in _cut(raw)])]
            first = k + 1
            continue
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, _run(held)


def _run(raws: list[bytes]) -> list[np.ndarray]:
    starts, hashes = _segment(b"\n".join(raws))
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    at = np.searchsorted(starts, begins)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle as a
    whole, one without words none."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    out = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : n - w + 1 + j]
    return np.unique(mix64(out + np.uint64(w)))
