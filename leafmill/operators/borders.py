"""Sentence borders learned from the texts themselves, by language, without labels.

The method is the unsupervised one of Kiss and Strunk (2006). A word that is followed by a stop nearly always, is short
and has stops inside is an abbreviation: the log-likelihood ratio of "a stop follows with probability 0.99" against the
language's own rate is weighted by word length, inner stops and occurrences without a stop. Behind an abbreviation or a
single letter a sentence ends only before a capitalised word that starts sentences: one that follows the stops of other
words far more often than chance (a second log-likelihood ratio), or one that is written small elsewhere and never
capitalised within a sentence. Before a word in lower case no stop ends a sentence.

Scale: one pass over the texts counts words by language and by what stands before them, in Python workers that
hold some ``HELD`` bytes of texts at once (or a single text); all else is worked out from that table of counts,
which holds words and not texts. Words that are frequent enough to be learned are found first, so that what stands before
words is only gathered for those. Counts of a language of more than
``CORPUS`` words are scaled down to that size, so that thresholds mean the same on any amount of text; and a word needs
``LEAST`` scaled occurrences (one behind an abbreviation, for starters by spelling), so the abbreviations of a language are
fewer than a third of its scaled stops, and its starters fewer than a third of its scaled words. These are what the driver reads and what splitting carries in its function; texts are split where they lie.

Edge cases: null and empty texts count nothing and have no sentences; a null language is one of its own; a language that was
not learned has single letters and lower case only to go by; very long texts and repeated rows count whole, each for
itself; an empty table learns nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import broadcast_if_small, materialize

#: Words of a language that its counts are scaled to where it has more.
CORPUS = 1_000_000
LEAST = 3.0
ABBREVIATION, STARTER = 0.3, 30.0
#: Bytes of texts that a worker gathers before it counts their words and passes the counts on.
HELD = 1 << 23
_COUNTS = "lang string, before string, word string, n long, stop long, small long, capital long"
_DIGITS = str.maketrans("0123456789", "#" * 10)
# Pieces of text are told apart by ASCII white space, as in ``functions.text``.
_AFTER_STOP = re.compile(r"""[.!?]["')\]]*(?=\s)""", re.ASCII)
_FIRST = re.compile(r"\s*(\S+)", re.ASCII)


def _core(token: str) -> str:
    return token.strip(T.AROUND)


def _word(core: str) -> str:
    """What words are told apart by: lower case, digits alike, no punctuation behind."""
    return core.lower().rstrip(".,;:!?").translate(_DIGITS)


def _stopped(core: str) -> bool:
    return core.endswith(".") and not core.endswith("..")


def _small(core: str) -> bool:
    return core[:1].lower() == core[:1] != core[:1].upper()


def _capital(core: str) -> bool:
    return core[:1].upper() == core[:1] != core[:1].lower()


def _lower(cores: pa.Array) -> pa.Array:
    """Lower case as of ``str``, word by word; Arrow knows no final sigma. No word holds a line's end."""
    other = pc.invert(pc.string_is_ascii(cores))
    words = cores.filter(other)
    return pc.replace_with_mask(pc.ascii_lower(cores), other, pa.array("\n".join(words.to_pylist()).lower().split("\n") if len(words) else [], pa.string()))


def _codes(values: pa.DictionaryArray) -> np.ndarray:
    return values.indices.to_numpy().astype(np.int64)


def _count_texts(langs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows of ``partial_counts``."""
    # White space is trimmed first, so no token is empty but that of an empty text.
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    tokens, text = split.flatten().dictionary_encode(), pc.list_parent_indices(split).to_numpy()
    core = pc.utf8_trim(tokens.dictionary, T.AROUND)
    word = pc.replace_substring_regex(pc.utf8_rtrim(_lower(core), ".,;:!?"), "[0-9]", "#")
    point, pause = pc.ends_with(core, "."), pc.ends_with(core, "..")
    ends = pc.or_(pc.or_(pc.ends_with(core, "!"), pc.ends_with(core, "?")), pause)
    before = pc.if_else(ends, "!", pc.if_else(point, pc.binary_join_element_wise(word, ".", ""), ""))
    # A text begins as if a sentence had ended.
    before = pa.concat_arrays([before, pa.array(["!"])]).dictionary_encode()
    word, lang, first = word.dictionary_encode(), langs.dictionary_encode(), pc.utf8_slice_codeunits(core, 0, 1).dictionary_encode()
    cases = [np.array([of(x) for x in first.dictionary.to_pylist()], bool)[_codes(first)] for of in (_small, _capital)]
    flags = [pc.and_not(point, pause).to_numpy(zero_copy_only=False), *cases]

    token, befores = _codes(tokens), _codes(before)
    ahead = np.empty_like(token)
    ahead[1:] = befores[token[:-1]]
    ahead[np.flatnonzero(np.diff(text, prepend=-1))] = befores[-1]
    # Tokens of a language behind the same are counted first, then words.
    behind = _codes(lang)[text] * len(before.dictionary) + ahead
    pair, n = np.unique(behind * len(tokens.dictionary) + token, return_counts=True)
    behind, token = np.divmod(pair, max(len(tokens.dictionary), 1))
    key, at = np.unique(behind * len(word.dictionary) + _codes(word)[token], return_inverse=True)
    behind, of = np.divmod(key, max(len(word.dictionary), 1))
    spoken, ahead = np.divmod(behind, len(before.dictionary))
    # Sums of doubles are exact up to 2**53.
    sums = [np.bincount(at, n * flag, len(key)).astype(np.int64) for flag in (1, *(f[token] for f in flags))]
    columns = [x.dictionary.take(pa.array(i)) for x, i in ((lang, spoken), (before, ahead), (word, of))]
    rows = pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], [field.split()[0] for field in _COUNTS.split(", ")])
    return rows.filter(pc.not_equal(rows.column("word"), ""))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    half = batch.num_rows // 2
    if half and batch.nbytes > HELD:
        yield from _parts(batch.slice(0, half))
        yield from _parts(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for part in chain(chain.from_iterable(map(_parts, batches)), [None]):
        if held and (part is None or sum(b.nbytes for b in held) + part.nbytes > HELD):
            yield _count_texts(*(pa.concat_arrays([b.column(c) for b in held]) for c in range(2)))
            held = []
        held.append(part)


def partial_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows as of ``word_counts``, but there may be several of the same words, whose counts add up. Nothing is shuffled."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(_count, _COUNTS)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, before, word and how often: n, with a stop behind, small, capital. ``before`` is the word ahead with its
    stop, ``!`` behind another end of a sentence or the start of the text, and empty within a sentence."""
    return partial_counts(docs, text, lang).groupBy("lang", "before", "word").agg(*[F.sum(c).alias(c) for c in ("n", "stop", "small", "capital")])


def _scaled(counts: DataFrame) -> DataFrame:
    """Words, stops and scale of each language."""
    total = counts.groupBy("lang").agg(F.sum("n").alias("words"), F.sum("stop").alias("stops"))
    return total.withColumn("scale", F.least(F.lit(1.0), F.lit(float(CORPUS)) / F.col("words")))


def frequent_words(counts: DataFrame) -> DataFrame:
    """lang, word, n, stop, small, inside (capital within a sentence) of the words of ``word_counts`` or ``partial_counts``
    with ``LEAST`` scaled occurrences, and words, stops, scale of their language."""
    inside = F.sum(F.when(F.col("before") == "", F.col("capital")).otherwise(0)).alias("inside")
    per = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("stop").alias("stop"), F.sum("small").alias("small"), inside)
    per = per.join(broadcast_if_small(materialize(_scaled(counts), "languages")), "lang")
    return per.where((F.col("n") * F.col("scale") >= LEAST) & F.col("word").rlike(r"\p{L}"))


def abbreviations(frequent: DataFrame) -> DataFrame:
    """lang, word, score (to six places) of the ``frequent_words`` that are abbreviations."""
    per = frequent.where(F.col("stop") * F.col("scale") >= LEAST)
    rate = F.col("stops") / F.col("words")
    with_, without = F.col("stop") * F.col("scale"), (F.col("n") - F.col("stop")) * F.col("scale")
    ratio = 2 * (with_ * F.log(0.99 / rate) + without * F.log(0.01 / (1 - rate)))
    size = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - size + 1
    score = ratio * F.exp(-size - without * F.log(size.cast("double"))) * inner
    return per.where((F.col("stops") < F.col("words")) & (size > 0)).select("lang", "word", F.round(score, 6).alias("score")).where(F.col("score") >= ABBREVIATION)


def _both(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of a and b coming together ``ab`` times of their a and b in n."""

    def fit(k: Column, of: Column, p: Column) -> Column:
        part = lambda x, q: F.when(x > 0, x * F.log(q)).otherwise(0.0)
        return part(k, p) + part(of - k, 1 - p)

    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    return 2 * (fit(ab, a, p1) + fit(b - ab, n - a, p2) - fit(ab, a, p) - fit(b - ab, n - a, p))


def starters(counts: DataFrame, frequent: DataFrame, short: DataFrame) -> DataFrame:
    """lang, word, score of the ``frequent_words`` that start sentences, given the abbreviations: ``score`` is the
    log-likelihood ratio (to six places) of standing behind a sentence's end; a word below the threshold is there by its
    spelling, and only if it stands behind abbreviations at all."""
    known = short.select("lang", F.concat("word", F.lit(".")).alias("before"), F.lit(True).alias("known"))
    often = frequent.select("lang", "word", F.lit(True).alias("often"))
    ends = counts.where("before <> ''").join(broadcast_if_small(known), ["lang", "before"], "left").join(broadcast_if_small(often), ["lang", "word"], "left")
    # Neither abbreviations nor single letters end a sentence for certain.
    open_ = F.coalesce("known", F.lit(False)) | (F.length("before") == 2)
    # All words that are not frequent are one.
    ends = ends.groupBy("lang", F.when(F.col("often"), F.col("word")).alias("word")).agg(
        F.sum(F.when(~open_, F.col("n"))).alias("first"), F.sum(F.when(open_, F.col("capital"))).alias("behind")
    )
    ends = materialize(ends, "sentence-ends")
    all_ends = ends.groupBy("lang").agg(F.sum("first").alias("ends")).where("ends IS NOT NULL")
    both = frequent.join(ends, ["lang", "word"], "left").join(broadcast_if_small(all_ends), "lang").where("ends < words")
    hits = F.coalesce("first", F.lit(0))
    s = F.col("scale")
    score = F.when(hits * F.col("words") > F.col("n") * F.col("ends"), _both(F.col("ends") * s, F.col("n") * s, hits * s, F.col("words") * s)).otherwise(0.0)
    both = both.withColumn("score", F.round(score, 6))
    spelled = (F.col("small") * s >= LEAST) & (F.col("inside") == 0) & (F.col("behind") * s >= 1)
    return both.where((F.col("score") >= STARTER) | spelled).select("lang", "word", "score")


@dataclass(frozen=True)
class Borders:
    """Learned words as ``language:word``."""

    short: frozenset[str]
    start: frozenset[str]

    def split(self, text: Column, lang: Column) -> Column:
        """Sentences of ``text`` in order, stripped, without blank ones."""
        sentences = self.sentences

        @F.arrow_udf("array<string>")
        def split(texts: pa.Array, langs: pa.Array) -> pa.Array:
            return pa.array([sentences(t.as_py(), lang) for t, lang in zip(texts, langs.to_pylist())], pa.list_(pa.string()))

        return split(text, F.coalesce(lang.cast("string"), F.lit("")))

    def sentences(self, text: str | None, lang: str) -> list[str] | None:
        """``split`` for a single text. A sentence ends at a stop mark, closing quotes or brackets, and white space, but
        where ``_goes_on``."""
        if text is None:
            return None
        pieces = _AFTER_STOP.sub(rf"\g<0>{T.END}", text).split(T.END)
        out, at = [], 0
        for n in range(1, len(pieces) + 1):
            if n == len(pieces) or not self._goes_on(pieces[n - 1], pieces[n], lang):
                if sentence := (pieces[at] if n == at + 1 else "".join(pieces[at:n])).strip():
                    out.append(sentence)
                at = n
        return out

    def _goes_on(self, piece: str, following: str, lang: str) -> bool:
        """Whether the sentence does not end between two neighbouring pieces."""
        if not piece.rstrip(T.AROUND).endswith("."):
            return False
        token = piece[piece.rfind(" ") + 1 :]
        # Other white space cannot be printed.
        last = _core(token if token.isprintable() else _last(token))
        if not last.endswith("."):
            return False
        first = _FIRST.match(following)
        next_ = _core(first[1]) if first else ""
        if _small(next_):
            return True
        # Points in a row are a pause, not an abbreviation.
        if not _stopped(last):
            return False
        word = _word(last)
        short = len(word) == 1 or f"{lang}:{word}" in self.short
        return short and not (_capital(next_) and f"{lang}:{_word(next_)}" in self.start)


def _last(token: str) -> str:
    return re.split(r"\s", token, flags=re.ASCII)[-1]


def learned_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Abbreviations and starters of ``docs``, each with lang, word, score."""
    counts = materialize(partial_counts(docs, text, lang), "word-counts")
    frequent = materialize(frequent_words(counts), "frequent-words")
    short = materialize(abbreviations(frequent), "abbreviations")
    return short, starters(counts, frequent, short)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Borders:
    """Abbreviations and starters of every language of ``docs``; what is collected has a bound for each language."""
    short, start = learned_words(docs, text, lang)
    named = F.concat("lang", F.lit(":"), "word").alias("w")
    return Borders(*[frozenset(r["w"] for r in t.select(named).collect()) for t in (short, start)])
