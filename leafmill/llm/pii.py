"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

Tokens are runs of non-space characters. A token is *marked* if it holds a digit, ``@`` or ``+``, or spells out a
part of an address (``[at]``, ``(dot)``, ``dot``). The field gives the label O, by a hard constraint, to tokens
with no marked one among the ``REACH`` tokens on either side, so a text falls apart, without any approximation,
into runs of other tokens between two O's; words in those runs are decoded like numbers. Each token's features are
its own word shape, and the words (those of the labelled table) or else shapes of its neighbours, of whole tokens
however long, hashed to ``FEATURES`` rows of weights. Labels are O and B-/I- of each kind. The field is trained by
maximum likelihood on a small labelled table (``pii_examples``; a caller may give another one), which holds above
all what the patterns miss: addresses spelled out or in brackets, national phone numbers, other groupings. Runs are
decoded by Viterbi in numpy batches, with forward-backward posteriors.

The result holds all spans of the fixed patterns, and those spans of the field that overlap none of
them, whose tokens all have a posterior of at least ``least``, and whose digits their kind allows: a card passes
Luhn, parts of an IP are at most 255, a phone number has 7 to 15 digits (kinds ``model_*``).

Scale: a map without a shuffle over whole texts; only the weight table goes out. Pattern search is linear in the
text, also for hostile ones. Runs are decoded as they are found, some ten thousand tokens at a time; a longer run is
decoded exactly in pieces, of which it keeps some thirty bytes a token.

Edge cases: null text counts as empty and gives zero counts, the hash of the empty string and an empty
span list; a table without any run trains a field that finds nothing; repeated rows get equal answers; of equal
scores the label first in order is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.pii_examples import labelled_table

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)
FEATURES = 1 << 15
#: Tokens on either side of a marked one that the field decodes.
REACH = 3
#: Tokens of a batch, and those beyond which a run is decoded in pieces.
BATCH, LONG = 10_000, 2048

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKS = re.compile(r"[0-9@+]+")
_SPACE = " \t\n\v\f\r"
_EDGE = "()[]{}<>\"'.,;:!?"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the fixed patterns by start, then kind: leftmost, not overlapping within
    a kind; matches that fail a kind's test are dropped."""
    if not _ANY.search(text):
        return []
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def token_runs(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of neighbouring tokens that are not plain, as (start, stop) of each token."""
    runs: list[list[tuple[int, int]]] = []
    stop = 0
    for m in _MARKS.finditer(text):
        if m.start() < stop:
            continue
        start = m.start()
        while start > stop and text[start - 1] not in _SPACE:
            start -= 1
        joined = bool(runs) and not text[stop:start].strip(_SPACE)
        stop = m.end()
        while stop < len(text) and text[stop] not in _SPACE:
            stop += 1
        if joined:
            runs[-1].append((start, stop))
        else:
            runs.append([(start, stop)])
    return runs


_CUES = re.compile(r"[0-9@+]+|[\[({<][ ]?(?:at|dot)[ ]?[\])}>]|(?<![^ \t\n\v\f\r])dot(?![^ \t\n\v\f\r])", re.I)
_TOKEN = re.compile(r"[^ \t\n\v\f\r]+")


class Run:
    """Neighbouring tokens of a text, by their places."""

    def __init__(self, text: str, words: frozenset[str]):
        self.text, self.words = text, words
        self.starts, self.stops = array("q"), array("q")

    def __len__(self) -> int:
        return len(self.starts)

    def places(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.stops, strict=True))

    def rows(self, lo: int, hi: int) -> list[tuple[int, ...]]:
        """Feature rows of the tokens from ``lo`` to before ``hi``."""
        token = lambda k: self.text[self.starts[k] : self.stops[k]] if 0 <= k < len(self.starts) else None
        return _rows([token(k) for k in range(lo - 2, hi + 1)], self.words)


def zones(text: str, words: frozenset[str] = frozenset()) -> list[Run]:
    """Maximal runs of tokens with a marked one among the ``REACH`` tokens on either side."""
    runs: list[Run] = []
    stop = known = 0  # behind the last token of the last run, and behind its reach
    for m in _CUES.finditer(text):
        if m.end() <= known and runs:
            continue  # the token was marked before
        start = m.start()
        while start > stop and text[start - 1] not in _SPACE:
            start -= 1
        known = m.end()
        while known < len(text) and text[known] not in _SPACE:
            known += 1
        for _ in range(REACH):
            back = start
            while back > stop and text[back - 1] in _SPACE:
                back -= 1
            if back == stop:
                break
            start = back
            while start > stop and text[start - 1] not in _SPACE:
                start -= 1
        joined = bool(runs) and not text[stop:start].strip(_SPACE)
        run = runs[-1] if joined else Run(text, words)
        if not joined:
            runs.append(run)
        left = REACH - sum(a >= known for a in run.starts[-REACH:])
        for t in _TOKEN.finditer(text, max(start, stop)):
            if t.start() >= known:
                if not left:
                    break
                left -= 1
            run.starts.append(t.start())
            run.stops.append(t.end())
        stop = run.stops[-1]
    return runs


_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|\w+")


def _shaped(token: str) -> str:
    """Upper case X, lower case x, digits d, other letters w, each with its length up to 5, then 9."""

    def code(m: re.Match) -> str:
        c, n = m[0][0], len(m[0])
        kind = "X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" else "d" if "0" <= c <= "9" else "w"
        return f"{kind}{n if n <= 5 else 5 if n < 9 else 9}"

    return _RUNS.sub(code, token)


_short_shape = lru_cache(maxsize=1 << 16)(_shaped)


def _shape(token: str) -> str:
    return _short_shape(token) if len(token) <= 64 else _shaped(token)


def _hashed(slot: str, value: str) -> int:
    return zlib.crc32(f"{slot}:{value}".encode("utf-8", "surrogatepass")) % FEATURES


_short_row = lru_cache(maxsize=1 << 17)(_hashed)


def _row(slot: str, value: str) -> int:
    return _short_row(slot, value) if len(value) <= 96 else _hashed(slot, value)


_LENGTHS = re.compile(r"(?<=[Xxdw])[0-9]")
WIDTH = 11


def _rows(tokens: list[str | None], words: frozenset[str]) -> list[tuple[int, ...]]:
    """Feature rows of ``tokens`` but the first two and the last one, which are their neighbours; None is the
    end of a run."""
    shapes = ["~" if t is None else _shape(t) for t in tokens]
    plain = [_LENGTHS.sub("", s) for s in shapes]
    keys = [s if t is None or (w := t.strip(_EDGE).lower()) not in words else f"={w}" for t, s in zip(tokens, shapes, strict=True)]
    out = []
    for k in range(2, len(tokens) - 1):
        token, c = tokens[k], shapes[k]
        digits = sum(map(token.count, "0123456789"))
        out.append((
            _row("c", c), _row("k", keys[k]), _row("p", keys[k - 1]), _row("n", keys[k + 1]), _row("pc", f"{keys[k - 1]} {c}"),
            _row("cn", f"{c} {keys[k + 1]}"), _row("q", f"{keys[k - 2]} {c[:2]}"), _row("d", f"{digits} {token[0]}"),
            _row("g", plain[k]), _row("pg", f"{plain[k - 1]} {plain[k]}"), _row("gn", f"{plain[k]} {plain[k + 1]}"),
        ))
    return out


def run_features(text: str, run: list[tuple[int, int]], words: frozenset[str] = frozenset()) -> list[tuple[int, ...]]:
    """Feature rows of each token of a run; beyond the run's ends there are no tokens."""
    return _rows([None, None, *(text[a:b] for a, b in run), None], words)


def run_labels(run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """B-/I- labels of a run's tokens from known spans."""
    out = []
    for a, b in run:
        label = 0
        for start, kind, stop in spans:
            if start < b and stop > a:
                label = 1 + 2 * kind + (start < a)
                break
        out.append(label)
    return out


def _padded(runs: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in runs])
    rows = np.zeros((len(runs), n.max(), WIDTH), np.int64)
    for k, r in enumerate(runs):
        rows[k, : len(r)] = r
    return rows, n


class Field:
    """Weights (features x labels) and transitions (labels x labels) of the linear chain."""

    def __init__(self, words: frozenset[str] = frozenset()) -> None:
        """``words``: those that count as themselves, not by their shape."""
        self.words = words
        self.w = np.zeros((FEATURES, LABELS))
        self.t = np.zeros((LABELS, LABELS))
        ban = np.zeros((LABELS, LABELS))
        for kind in range(len(KINDS)):
            inside = 2 + 2 * kind
            ban[:, inside] = -1e4
            ban[inside - 1 : inside + 1, inside] = 0.0
        self.ban = ban  # an I- label only follows its own B- or I-

    def _passes(self, e: np.ndarray, n: np.ndarray):
        """Log forward and backward scores; every run begins after and ends before an O."""
        t = self.t + self.ban
        steps = e.shape[1]
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0] + t[0]
        for k in range(1, steps):
            f[:, k] = e[:, k] + np.logaddexp.reduce(f[:, k - 1, :, None] + t, axis=1)
        for k in range(steps - 1, -1, -1):
            last = (k == n - 1)[:, None]
            nxt = np.logaddexp.reduce(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2) if k + 1 < steps else np.zeros(e[:, 0].shape)
            b[:, k] = np.where(last, t[:, 0], nxt)
        z = np.logaddexp.reduce(f[:, 0] + b[:, 0], axis=1)
        return t, f, b, z

    def _expected(self, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the labels, and expected transitions in all, with sums scaled step by step."""
        s, x = np.exp(self.t + self.ban), np.exp(e - e.max(axis=2, keepdims=True))
        steps = e.shape[1]
        f, b, scale = np.zeros_like(x), np.zeros_like(x), np.ones((len(n), steps, 1))
        for k in range(steps):
            own = (f[:, k - 1] @ s if k else s[0]) * x[:, k]
            scale[:, k] = own.sum(axis=1, keepdims=True)
            f[:, k] = own / scale[:, k]
        moved = np.zeros_like(self.t)
        for k in range(steps - 1, -1, -1):
            end = (k == n - 1)[:, None]
            nxt = x[:, k + 1] * b[:, k + 1] / scale[:, k + 1] if k + 1 < steps else np.zeros_like(x[:, 0])
            nxt = np.where((k + 1 < n)[:, None], nxt, 0.0)
            b[:, k] = np.where(end, s[:, 0] / (f[:, k] @ s[:, 0])[:, None], nxt @ s.T)
            if k + 1 < steps:
                moved += s * (f[:, k].T @ nxt)
        seen = f * b
        moved[0] += seen[:, 0].sum(axis=0)
        moved[:, 0] += seen[np.arange(len(n)), n - 1].sum(axis=0)
        return seen, moved

    def fit(self, runs: list, labels: list, rounds: int = 120, rate: float = 0.1, decay: float = 2e-5) -> Field:
        """Full-batch gradient ascent (Adam) on the conditional log-likelihood."""
        if not runs:
            return self
        rows, n = _padded(runs)
        used, rows = np.unique(rows, return_inverse=True)
        rows = rows.reshape(len(runs), -1, WIDTH)
        y = np.zeros(rows.shape[:2], np.int64)
        for k, own in enumerate(labels):
            y[k, : len(own)] = own
        mask = np.arange(rows.shape[1]) < n[:, None]
        w = self.w[used]
        cells = (rows[mask][:, :, None] * LABELS + np.arange(LABELS)).reshape(-1)

        def summed(share: np.ndarray) -> np.ndarray:
            """Per feature and label, the sum of ``share`` (tokens x labels) over the tokens that have the feature."""
            return np.bincount(cells, np.repeat(share[:, None, :], WIDTH, axis=1).reshape(-1), len(used) * LABELS).reshape(w.shape)

        real_w, real_t = summed(np.eye(LABELS)[y[mask]]), np.zeros_like(self.t)
        np.add.at(real_t, (0, y[:, 0]), 1.0)
        np.add.at(real_t, (y[np.arange(len(n)), n - 1], 0), 1.0)
        both = mask[:, 1:]
        np.add.at(real_t, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        state = [np.zeros_like(x) for x in (w, w, self.t, self.t)]
        for step in range(1, rounds + 1):
            seen, want_t = self._expected(w[rows].sum(axis=2), n)
            want_w = summed(seen[mask])
            for x, g, m, v in ((w, real_w - want_w, 0, 1), (self.t, real_t - want_t, 2, 3)):
                g = g / len(n) - decay * x
                state[m] = 0.9 * state[m] + 0.1 * g
                state[v] = 0.99 * state[v] + 0.01 * g * g
                x += rate * (state[m] / (1 - 0.9**step)) / (np.sqrt(state[v] / (1 - 0.99**step)) + 1e-8)
        self.w[used] = w
        return self

    def decode(self, runs: Sequence[Run | list]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Viterbi labels and their posteriors, for runs (or lists of feature rows) in batches of like length."""
        out: list = [None] * len(runs)
        for k, run in enumerate(runs):
            if len(run) > LONG:
                out[k] = self._long(run)
        order = sorted((k for k in range(len(runs)) if out[k] is None), key=lambda k: len(runs[k]))
        at = 0
        while at < len(order):
            longest = max(8, 2 * len(runs[order[at]]))
            stop = at
            while stop < len(order) and len(runs[order[stop]]) <= longest and (stop - at) * longest < BATCH:
                stop += 1
            group = order[at:stop]
            rows, n = _padded([_part(runs[k], 0, len(runs[k])) for k in group])
            e = self.w[rows].sum(axis=2)
            t, fwd, bwd, z = self._passes(e, n)
            best = e[:, 0] + t[0]
            back = np.zeros(e.shape, np.int8)
            final = np.where((n == 1)[:, None], best + t[:, 0], 0)
            for k in range(1, e.shape[1]):
                step = best[:, :, None] + t
                back[:, k] = step.argmax(axis=1)
                best = step.max(axis=1) + e[:, k]
                final = np.where((n == k + 1)[:, None], best + t[:, 0], final)
            label = final.argmax(axis=1)
            path = np.zeros(e.shape[:2], np.int64)
            for k in range(e.shape[1] - 1, -1, -1):
                on = k < n
                path[on, k] = label[on]
                label = np.where(on & (k > 0), back[np.arange(len(n)), k, label], label)
            sure = np.exp(np.minimum(np.take_along_axis(fwd + bwd, path[..., None], 2)[..., 0] - z[:, None], 0))
            for k, own, p, m in zip(group, path, sure, n, strict=True):
                out[k] = (own[:m], p[:m])
            at = stop
        return out


    def _long(self, run: Run | list) -> tuple[np.ndarray, np.ndarray]:
        """``decode`` of one long run, in pieces. Forward sums are kept at the start of each piece and made again,
        piece by piece, when the backward sums come by; of the best paths only the label before is kept."""
        total, t = len(run), self.t + self.ban
        step = np.exp(t)
        back = np.zeros((total, LABELS), np.int8)
        heads: list[np.ndarray] = []
        best = f = None

        def scores(lo: int) -> np.ndarray:
            return self.w[np.array(_part(run, lo, min(total, lo + LONG)))].sum(axis=1)

        def forward(f: np.ndarray | None, e: np.ndarray) -> np.ndarray:
            f = (step[0] if f is None else f @ step) * np.exp(e - e.max())
            return f / f.sum()

        for lo in range(0, total, LONG):
            heads.append(f)
            for k, e in enumerate(scores(lo), lo):
                f = forward(f, e)
                if best is None:
                    best = e + t[0]
                else:
                    path = best[:, None] + t
                    back[k] = path.argmax(axis=0)
                    best = path.max(axis=0) + e
        labels, sure = np.zeros(total, np.int64), np.zeros(total)
        label, b = int((best + t[:, 0]).argmax()), step[:, 0]
        for lo in range((total - 1) // LONG * LONG, -1, -LONG):
            own, f, sums = scores(lo), heads.pop(), []
            for e in own:
                f = forward(f, e)
                sums.append(f)
            for k in range(len(own) - 1, -1, -1):
                both = sums[k] * b
                labels[lo + k], sure[lo + k] = label, both[label] / both.sum()
                label = int(back[lo + k, label])
                b = step @ (np.exp(own[k] - own[k].max()) * b)
                b = b / b.sum()
        return labels, sure


def _part(run: Run | list, lo: int, hi: int) -> list[tuple[int, ...]]:
    return run.rows(lo, hi) if isinstance(run, Run) else run[lo:hi]


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    while start < stop and text[start] in _EDGE.replace("(", ""):
        start += 1
    while start < stop and text[stop - 1] in _EDGE:
        stop -= 1
    return start, stop


_NUMBER = re.compile(r"[0-9]+")


def _allowed(kind: int, value: str) -> bool:
    parts = _NUMBER.findall(value)
    digits = "".join(parts)
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if KINDS[kind] == "ip":
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    return KINDS[kind] != "phone" or 7 <= len(digits) <= 15


def model_spans(text: str, runs: list, decoded: list, spans: list, least: float) -> list[tuple[int, int, int]]:
    """Spans that the field adds: away from known spans, every token sure enough. ``spans`` are in order of their starts
    and may overlap, so for each the furthest end up to it is kept: one search tells whether any of them is touched."""
    added = []
    starts = [a for a, _, _ in spans]
    furthest = list(accumulate((b for _, _, b in spans), max))
    for run, (labels, sure) in zip(runs, decoded, strict=True):
        if not labels.any():
            continue
        run = run.places() if isinstance(run, Run) else run
        k = 0
        while k < len(run):
            if labels[k] == 0:
                k += 1
                continue
            kind, stop = (labels[k] - 1) // 2, k + 1
            while stop < len(run) and labels[stop] == 2 + 2 * kind:
                stop += 1
            start, end = _trimmed(text, run[k][0], run[stop - 1][1])
            new = start < end and sure[k:stop].min() >= least and _allowed(kind, text[start:end])
            behind = bisect_left(starts, end) if new else 0
            if new and not (behind and furthest[behind - 1] > start):
                added.append((start, len(KINDS) + int(kind), end))
            k = stop
    return added


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, rounds: int = 150) -> Field:
    """Fit the field on a small labelled table: (text, spans), a span being (start, stop, kind). Words that stand
    outside spans, or spell out an address, twice or more in it are features of their own."""
    table = labelled_table() if table is None else table
    seen: Counter[str] = Counter()
    for text, spans in table:
        for m in _TOKEN.finditer(text):
            word = m[0].strip(_EDGE).lower()
            if word.isalpha() and (word in ("at", "dot") or not any(a < m.end() and b > m.start() for a, b, _ in spans)):
                seen[word] += 1
    field = Field(frozenset(w for w, n in seen.items() if n > 1))
    runs, labels = [], []
    for text, spans in table:
        known = [(a, KINDS.index(kind), b) for a, b, kind in spans]
        for run in zones(text):
            places = run.places()
            # Once more with all words by their shape, so that other surroundings do as well.
            for words in (field.words, frozenset()):
                runs.append(run_features(text, places, words))
                labels.append(run_labels(places, known))
    return field.fit(runs, labels, rounds)


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field of the table that comes with the package; it depends on nothing else, so it is fitted once."""
    return train()


def _found(texts: list[str], field: Field, least: float) -> Iterator[list[tuple[int, int, int]]]:
    """All spans of each text: (start, kind, stop), the field's kinds behind the patterns'."""
    held: list[tuple[str, list, list[Run]]] = []
    tokens = 0

    def flush() -> Iterator[list[tuple[int, int, int]]]:
        decoded = iter(field.decode([r for _, _, runs in held for r in runs]))
        for text, spans, runs in held:
            yield sorted(spans + model_spans(text, runs, [next(decoded) for _ in runs], spans, least))

    for text in texts:
        runs = zones(text, field.words)
        held.append((text, pattern_spans(text), runs))
        tokens += sum(map(len, runs))
        if tokens > BATCH:
            yield from flush()
            held, tokens = [], 0
    yield from flush()


def scan_pii(docs: DataFrame, field: Field, least: float = 0.9) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, found (array of kind, start, stop by start
    and kind; the field's kinds are named ``model_*``)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*KINDS, *(f"model_{k}" for k in KINDS)]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = [[{"kind": names[k], "start": a, "stop": b} for a, k, b in spans] for spans in _found(texts, sent.value, least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, found array<struct<kind:string,start:int,stop:int>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, a count per pattern kind, base_sha256, spans, n_model."""
    of = lambda kinds: F.filter("found", lambda s: s["kind"].isin(list(kinds)))
    return scan_pii(docs, default_field()).select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(of(KINDS)), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"].startswith("model_"))).cast("long").alias("n_model"),
    )
