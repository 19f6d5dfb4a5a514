"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The pieces of a SentencePiece model are the patterns of an Aho-Corasick automaton over characters. One
pass over a text follows goto and failure links; at each position the output links give every piece
that ends there, longest first, and each relaxes the best score of a segmentation up to that position.
A character that no piece covers falls back to the model's byte pieces. Equal scores keep the longer
last piece.

Scores: the piece scores of a BPE model are merge ranks, not log-probabilities; they are turned into
those of Zipf's law, ``-log(2 + rank)``. The scores of a unigram model are used as they are. A byte
costs ``BYTE_COST`` more than the worst piece. Scores are whole multiples of 2**-16, so that sums, and
with them ties, do not depend on where a text is cut. The segmentation is the one of greatest total score;
for a BPE model that is not always the one its merges would give.

Spaces become U+2581 after one leading U+2581 is put in front. In such models U+2581 stands only at the
start of a piece, so every segmentation has a border before each run of U+2581, and a text falls
apart, without any approximation, into units of a run and what follows. Units are segmented once per
task in numpy batches (a few long ones, as of text without spaces, one by one) and then looked up. Decoding restores the text exactly: U+2581 in the input
itself is written in bytes.

Scale: a map without a shuffle over whole texts in bounded pieces; the automaton (some MB, fixed by the
model file) is broadcast; the table of known units is emptied when it reaches ``KNOWN`` entries.

Edge cases: null stays null ids; empty text gives an empty list; repeated rows get equal answers; of segmentations
of equal score the one with longer last pieces is taken; an empty table gives an empty result; columns beside the
text and those to ``keep`` are left out, and one to keep may not have the name of a result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a U+2581 of the input; a lone surrogate cannot occur in a Spark string.
OWN_MARK = "\udfff"
BYTE_COST = 10.0
KNOWN = 300_000
PIECE_CHARS = 1 << 20
#: Under so many units of more than so many characters, a step over all of them at once costs more than one by one.
FEW, BRIEF = 48, 64
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class Automaton:
    """Goto, failure and output links in arrays, with the piece and its score at each final state."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int32)
        nexts: list[dict[str, int]] = [{}]
        piece, depth = [-1], [0]
        for k, p in enumerate(pieces):
            if not usable[k]:
                continue
            at = 0
            for c in p:
                to = nexts[at].get(c)
                if to is None:
                    to = nexts[at][c] = len(nexts)
                    nexts.append({})
                    piece.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            if piece[at] < 0 or scores[k] > scores[piece[at]]:
                piece[at] = k
        fail, out = [0] * len(nexts), [0] * len(nexts)
        queue = deque(nexts[0].values())
        while queue:
            at = queue.popleft()
            for c, to in nexts[at].items():
                back = fail[at]
                while back and c not in nexts[back]:
                    back = fail[back]
                fail[to] = nexts[back].get(c, 0)
                out[to] = fail[to] if piece[fail[to]] >= 0 else out[fail[to]]
                queue.append(to)
        keys, targets = [], []
        for at, own in enumerate(nexts):
            for c, to in own.items():
                keys.append(at << 21 | ord(c))
                targets.append(to)
        order = np.argsort(keys)
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.fail, self.out = np.array(fail, np.int32), np.array(out, np.int32)
        self.piece, self.depth = np.array(piece, np.int32), np.array(depth, np.int32)
        whole = np.round(np.array(scores) * 65536).astype(np.int64)
        self.score = np.where(self.piece >= 0, whole[self.piece], 0)
        self.links: tuple | None = None
        self.byte_score = int(whole[np.array(usable)].min() - BYTE_COST * 65536)
        if any(MARK in p.lstrip(MARK) for p, u in zip(pieces, usable, strict=True) if u):
            raise ValueError("a piece holds U+2581 after another character")

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Goto with failure links, for many texts at once."""
        state = state.copy()
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) << 21 | char[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[todo[hit]] = self.targets[at[hit]]
            todo = todo[~hit]
            lost = state[todo] == 0
            todo = todo[~lost]
            state[todo] = self.fail[state[todo]]
        return state

    def segment_long(self, unit: str) -> np.ndarray:
        """Piece ids of one unit, character by character: for long units of which there are few."""
        if self.links is None:
            go = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))
            self.links = go, *(x.tolist() for x in (self.fail, self.out, self.piece, self.depth, self.score))
        go, fail, out, piece, depth, score = self.links
        best, back, state = [0] * (len(unit) + 1), [0] * (len(unit) + 1), 0
        for pos, c in enumerate(map(ord, unit)):
            while (to := go.get(state << 21 | c)) is None and state:
                state = fail[state]
            state = to or 0
            wide = 3 if c == ord(OWN_MARK) else 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            top, by = best[pos] + wide * self.byte_score, 0
            at = state if piece[state] >= 0 else out[state]
            while at:
                reach = best[pos + 1 - depth[at]] + score[at]
                if reach > top:
                    top, by = reach, at
                at = out[at]
            best[pos + 1], back[pos + 1] = top, by
        ids: list[int] = []
        pos = len(unit)
        while pos:
            at = back[pos]
            if at:
                ids.append(piece[at])
                pos -= depth[at]
            else:
                pos -= 1
                raw = MARK if unit[pos] == OWN_MARK else unit[pos]
                ids.extend(self.byte_ids[list(raw.encode("utf-8", "surrogatepass"))[::-1]].tolist())
        return np.array(ids[::-1], np.int32)

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units, flat, and how many each has."""
        if len(units) < FEW and max(map(len, units)) > BRIEF:
            each = [self.segment_long(u) for u in units]
            return np.concatenate(each), np.array([len(x) for x in each])
        raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], begin[order]
        longest = int(size[0])
        n = len(units)
        best = np.zeros((n, longest + 1), np.int64)
        back = np.full((n, longest + 1), -1, np.int32)
        state = np.zeros(n, np.int32)
        for pos in range(longest):
            live = int(np.searchsorted(-size, -pos, side="left"))  # units longer than pos
            char = raw[begin[:live] + pos]
            state[:live] = self.step(state[:live], char)
            wide = np.where(char == ord(OWN_MARK), 3, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
            top = best[:live, pos] + wide * self.byte_score
            by = np.full(live, -1, np.int32)
            at = np.where(self.piece[state[:live]] >= 0, state[:live], self.out[state[:live]])
            rows = np.flatnonzero(at)
            while len(rows):
                s = at[rows]
                reach = best[rows, pos + 1 - self.depth[s]] + self.score[s]
                # A covered character is never written in bytes: its one-character piece costs less.
                better = reach > top[rows]
                top[rows[better]], by[rows[better]] = reach[better], s[better]
                at[rows] = self.out[s]
                rows = rows[at[rows] > 0]
            best[:live, pos + 1], back[:live, pos + 1] = top, by
        pos, rows = size.copy(), np.arange(n)
        got_row, got_pos, got_id = [], [], []
        while len(rows):
            s = back[rows, pos[rows]]
            got_row.append(rows)
            got_pos.append(pos[rows].copy())
            got_id.append(np.where(s >= 0, self.piece[s], -1))
            pos[rows] -= np.where(s >= 0, self.depth[s], 1)
            rows = rows[pos[rows] > 0]
        row, at, ids = np.concatenate(got_row), np.concatenate(got_pos), np.concatenate(got_id)
        row_of = order[row]
        place = np.lexsort((at, row_of))
        row, at, ids, row_of = row[place], at[place], ids[place], row_of[place]
        if (ids < 0).any():
            code = raw[begin[row] + at - 1]
            flat, rows_of = [], []
            for k, own, c in zip(row_of, ids, code, strict=True):
                text = MARK if c == ord(OWN_MARK) else chr(c)
                more = [own] if own >= 0 else self.byte_ids[list(text.encode("utf-8", "surrogatepass"))]
                flat.extend(more)
                rows_of.extend([k] * len(more))
            ids, row_of = np.array(flat, np.int32), np.array(rows_of)
        return ids.astype(np.int32), np.bincount(row_of, minlength=n)


def load_automaton(path: str = MODEL) -> Automaton:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(k) for k in range(n)]
    usable = [not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)) for k in range(n)]
    scores = [sp.get_score(k) for k in range(n)]
    if all(s == int(s) for s in scores):
        scores = [-float(np.log(2.0 - s)) for s in scores]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Automaton(pieces, scores, usable, byte_ids)


class Encoder:
    """Encodes and decodes texts with a table of known units."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.is_byte = np.zeros(len(automaton.pieces), bool)
        self.is_byte[automaton.byte_ids] = True
        self.byte_of = {int(k): b for b, k in enumerate(automaton.byte_ids)}
        self.plain = [p.replace(MARK, " ") for p in automaton.pieces]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[str], first: int) -> None:
        need = first + len(new)
        if need > len(self.start):
            self.start, self.size = (np.concatenate([x[:first], np.zeros(2 * need - first, np.int64)]) for x in (self.start, self.size))
        order = sorted(range(len(new)), key=lambda k: len(new[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(new[order[stop]]) <= 1_000_000:
                stop += 1
            group = order[at:stop]
            ids, size = self.a.segment([new[k] for k in group])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            where = first + np.array(group)
            self.start[where], self.size[where] = self.used + np.cumsum(size) - size, size
            self.used += len(ids)
            at = stop

    def _look_up(self, units: list[str]) -> np.ndarray:
        """The number of each unit; new ones are segmented first."""
        known = self.known
        fresh = [u for u in dict.fromkeys(units) if u not in known]
        if fresh:
            first = len(known)
            known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self._learn(fresh, first)
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _pieces(self, text: str) -> Iterator[str]:
        """The prepared text in bounded parts that start at a border between units."""
        s = MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)
        at = 0
        while len(s) - at > PIECE_CHARS:
            stop = s.find(MARK, at + PIECE_CHARS)
            while stop > 0 and s[stop - 1] == MARK:
                stop = s.find(MARK, stop + 1)
            if stop < 0:
                break
            yield s[at:stop]
            at = stop
        yield s[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.known) > KNOWN:
            self.clear()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        units: list[str] = []
        owner: list[tuple[int, int]] = []
        chars = 0

        def flush() -> None:
            if not units:
                return
            index = self._look_up(units)
            size = self.size[index]
            shift = np.repeat(self.start[index] - (np.cumsum(size) - size), size)
            flat = self.ids[shift + np.arange(len(shift))]
            stops = np.cumsum(size)
            at = done = 0
            for k, n in owner:
                at += n
                stop = int(stops[at - 1])
                out[k].append(flat[done:stop])
                done = stop

        for k, text in enumerate(texts):
            for part in self._pieces(text) if text else ():
                own = _UNIT.findall(part)
                units += own
                owner.append((k, len(own)))
                chars += len(part)
                if chars > PIECE_CHARS:
                    flush()
                    units, owner, chars = [], [], 0
        flush()
        none = np.zeros(0, np.int32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``ids`` came from."""
        if not len(ids):
            return ""
        if not self.is_byte[ids].any():
            return "".join([self.plain[k] for k in ids.tolist()])[1:]
        parts: list[bytes] = []
        for k in ids.tolist():
            b = self.byte_of.get(k)
            parts.append(self.plain[k].encode() if b is None else bytes((b,)))
        return b"".join(parts).decode("utf-8", "replace")[1:]


def _chunks(texts: list[str | None], chars: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if len(texts) > at:
        yield at, len(texts)


def encode_report(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs`` (text and the ``keep`` columns): keep, n_tokens, n_bytes (pieces
    written in bytes), round_trip (decoding gives the text back), ids."""
    if set(keep) & {"n_tokens", "n_bytes", "round_trip", "ids"}:
        raise ValueError("a column to keep has the name of a result")
    sent = docs.sparkSession.sparkContext.broadcast(load_automaton(path))
    names = [*keep, "n_tokens", "n_bytes", "round_trip", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in _chunks(texts):
                own = texts[a:b]
                got = enc.encode([t or "" for t in own])
                n = np.array([len(x) for x in got], np.int64)
                n_bytes = [int(enc.is_byte[x].sum()) for x in got]
                same = [enc.decode(x) == (t or "") for x, t in zip(got, own, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(got), pa.int32()))
                if any(t is None for t in own):
                    ids = pa.array([None if t is None else x for t, x in zip(own, ids.to_pylist(), strict=True)], pa.list_(pa.int32()))
                cols = [c.slice(a, b - a) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(n_bytes, pa.int64()), pa.array(same), ids], names)

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kinds, "n_tokens long, n_bytes long, round_trip boolean, ids array<int>"]))


def decode_column(encoded: DataFrame, ids: str = "ids", to: str = "text", path: str = MODEL) -> DataFrame:
    """``encoded`` with a column of decoded texts; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_automaton(path))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = Encoder(sent.value)
        for s in batches:
            yield s.map(lambda x: None if x is None else enc.decode(np.asarray(x, np.int64)))

    return encoded.withColumn(to, decode(F.col(ids)))
