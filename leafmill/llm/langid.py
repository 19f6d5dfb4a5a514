"""Language identification by a mixture of languages per document.

Learning: over labelled rows, lower-cased letter trigrams (anything but letters counts as one boundary
mark) are hashed into ``2**BITS`` cells and counted per language; smoothed shares give each language a
distribution over cells. Counts cover a hash-picked share of the labelled rows, all of them up to
``max_train`` rows (the bound on what is learned from).

Prediction: each document's language proportions are estimated by expectation-maximisation over its
trigrams. From the full mixture, languages are taken away smallest first; the set with the best
log-likelihood minus ``penalty * (languages - 1) * log(trigrams)`` is the document's language set,
and its largest language the prediction. A document that even its best set explains worse than chance (all
cells alike), by ``EVIDENCE`` nats or more, is in none of the learned languages; ``identified`` leaves it out.

Scale: training is one pass with a count table of bounded size (cells x languages) per partition,
merged by a grouped sum; the model that goes to the executors has cells times languages numbers, whatever the
data. More than ``max_langs`` labels are an error, not cut. Prediction is a map without a shuffle. Texts are processed whole, in bounded
batches of characters.

Edge cases: null text or text without a letter gives ``und`` with score 0; text whose trigrams are all
unseen gets the most common label's smoothed likelihood, so still a learned language; without any
labelled row every prediction is ``und`` (``identified`` then keeps the texts with a letter); of equal shares the
language first in order is predicted; null ids are hashed as an empty text; repeated rows get equal
answers; an empty table gives an empty result; other columns are ignored (kept by ``identified``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
CELLS = 1 << BITS
CHUNK = 1 << 20
UND = "und"
#: Nats by which chance must explain a text better than the learned languages do for it to be in none of them.
EVIDENCE = 20.0
_alphabet: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each UTF-16 unit its code (0: no letter). Surrogates have one: ``cells`` has replaced the
    characters outside the basic plane that are no letters."""
    if not _alphabet:
        table = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            if 0xD800 <= c < 0xE000 or chr(c).isalpha():
                table[c] = c + 1
        _alphabet.append(table)
    return _alphabet[0]


def cells(text: str) -> Iterator[np.ndarray]:
    """Cells of the trigrams of a text, in bounded pieces; boundary-only trigrams are left out."""
    for at in range(0, len(text), CHUNK):
        piece = text[max(0, at - 2) : at + CHUNK].lower()
        units = np.frombuffer(piece.encode("utf-16-le", "surrogatepass"), "<u2")
        if len(units) > len(piece):
            piece = "".join(c if c < "\U00010000" or c.isalpha() else " " for c in piece)
            units = np.frombuffer(piece.encode("utf-16-le", "surrogatepass"), "<u2")
        code = _letters()[units]
        if at == 0:
            code = np.concatenate([np.zeros(1, np.uint32), code])
        if at + CHUNK >= len(text):
            code = np.concatenate([code, np.zeros(1, np.uint32)])
        if len(code) < 3:
            continue
        a, b, c = code[:-2], code[1:-1], code[2:]
        h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield (h >> np.uint32(32 - BITS))[b > 0]


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a document and how often each occurs."""
    total = None
    for c in cells(text):
        if total is None and len(text) <= CHUNK:
            c.sort()
            at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
            return c[at], np.diff(np.append(at, len(c)))
        total = np.bincount(c, minlength=CELLS) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, prior: float = 0.5):
        """``counts``: languages x cells."""
        self.langs = langs
        self.like = ((counts + prior) / (counts + prior).sum(axis=1, keepdims=True)).T.copy()

    def proportions(self, like: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        share = np.full(like.shape[1], 1.0 / like.shape[1])
        for _ in range(rounds):
            joint = like @ share
            new = share * ((n / joint) @ like) / n.sum()
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(n @ np.log(like @ share))

    def select(self, text: str, rounds: int = 12, penalty: float = 1.0) -> tuple[list[tuple[str, float]], float]:
        """The selected languages with their proportions, largest first (none without letters or languages), and
        by how many nats they explain the text better than chance."""
        cell, n = _document(text)
        if not len(cell) or not self.langs:
            return [], 0.0
        like = self.like[cell]
        live = np.arange(len(self.langs))
        price = penalty * np.log(max(2, n.sum()))
        best, best_score = None, -np.inf
        while True:
            share, fit = self.proportions(like[:, live], n, rounds)
            score = fit - price * (len(live) - 1)
            if score > best_score:
                best, best_score = (live, share, fit), score
            if len(live) == 1:
                break
            # Shares that have all but vanished go at once; each step drops one at least.
            keep = share > max(1e-3, share.min())
            live = live[keep] if keep.any() else live[:1]
        live, share, fit = best
        order = np.lexsort((live, -share))
        return [(self.langs[live[k]], float(min(1.0, max(0.0, share[k])))) for k in order], fit + float(n.sum()) * np.log(CELLS)

    def languages(self, text: str, rounds: int = 12, penalty: float = 1.0) -> list[tuple[str, float]]:
        return self.select(text, rounds, penalty)[0]

    def recognises(self, text: str) -> bool:
        """The text has letters, and the learned languages explain it as well as chance does, or nearly."""
        found, better = self.select(text)
        return bool(found) and better > -EVIDENCE


def held_out(doc_id: Column) -> Column:
    """Rows that learning must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(labelled: DataFrame, max_train: int = 200_000, max_langs: int = 1024) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang). At most about ``max_train`` rows are counted,
    picked by a hash of doc_id; all labels are learned. More than ``max_langs`` of them, for which a driver would
    have to be larger, raise ValueError."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    per = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(per) > max_langs:
        raise ValueError(f"more than {max_langs} labels; raise max_langs if the driver can hold {CELLS} counts for each")
    langs = sorted(r["lang"] for r in per)
    total = sum(r["count"] for r in per)
    if total > max_train:
        part = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000))
        rows = rows.where(part < int(1_000_000 * max_train / total))
    at = {name: k for k, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang in at:
                    own = seen.setdefault(at[lang], np.zeros(CELLS, np.int64))
                    for c in cells(text):
                        own += np.bincount(c, minlength=CELLS)
        for lang, own in sorted(seen.items()):
            cell = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), lang)), pa.array(cell), pa.array(own[cell])], ["lang", "cell", "n"])

    summed = rows.select("text", "lang").mapInArrow(count, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(langs), CELLS))
    table = summed.toArrow()  # at most max_langs * CELLS rows
    counts[table["lang"].to_numpy(), table["cell"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score, langs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.languages(t or "") for t in batch.column(2).to_pylist()]
            lang = pa.array([f[0][0] if f else UND for f in found], pa.string())
            score = pa.array([f[0][1] if f else 0.0 for f in found], pa.float64())
            several = pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, score, several], ["doc_id", "held_out", "lang_pred", "score", "langs"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs array<string>")


def language_id(docs: DataFrame, **settings) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that are not held out, then predict every row."""
    model = train(docs.where(~held_out(F.col("doc_id"))), **settings)
    return identify(docs, model)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text and any other columns, all kept) that are in a learned language; where no
    language was learned, the rows whose text has a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            known = [own.recognises(t) if own.langs else any(len(c) for c in cells(t)) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
