"""Splitting long sections where neighbouring sentences have little in common."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.sentences import sentences
from leafmill.operators.embed import dot, hash_embed, unit_vectors
from leafmill.operators.pages import gathered

#: Sentences whose vectors are held at once.
HELD = 1024
_PLACES, _WIDE = Decimal("1e-9"), Context(prec=400)


def consecutive_similarity(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """``sentences`` (keys, pos, embedding) with ``sim``: inner product with the next sentence of the
    same keys, to nine places; null for the last one."""
    order = Window.partitionBy(*keys).orderBy("pos")
    following = F.lead("embedding").over(order)
    return sentences.withColumn("sim", F.when(following.isNotNull(), F.round(dot(F.col("embedding"), following), 9)))


def find_breakpoints(sims: DataFrame, keys: list[str], k: float | None = 1.5) -> DataFrame:
    """Adds ``brk``: the similarity lies under mean - k * population standard deviation of its section.
    k of 0 or None is 1.5."""
    k = k or 1.5
    whole = Window.partitionBy(*keys)
    limit = F.round(F.avg("sim").over(whole) - k * F.stddev_pop("sim").over(whole), 9)
    return sims.withColumn("brk", F.coalesce(F.col("sim") < limit, F.lit(False)))


def merge_at_breakpoints(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences between breaks joined by a space: keys, part (from 0), text. A break is after its row."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum(F.col("brk").cast("int")).over(before), F.lit(0))
    rows = flagged.withColumn("part", part.cast("int"))
    return rows.groupBy(*keys, "part").agg(gathered(F.struct("pos"), F.col("sentence"), " ").alias("text"))


def split_vectors(sentences: DataFrame, keys: list[str], k: float | None = 1.5) -> DataFrame:
    return merge_at_breakpoints(find_breakpoints(consecutive_similarity(sentences, keys), keys, k), keys)


def _rounded(x: float) -> float:
    """To nine places as Spark rounds: half up, of the shortest decimal."""
    scaled = abs(x) * 1e9
    if not scaled < 1e15 or abs(scaled % 1 - 0.5) < 1e-3:
        return float(Decimal(repr(x)).quantize(_PLACES, ROUND_HALF_UP, _WIDE)) if math.isfinite(x) else x
    return math.copysign(math.floor(scaled + 0.5) / 1e9, x)


def _neighbours(model: Callable, sentences: list[str], batch: int) -> Iterator[float]:
    """Inner products of neighbouring sentences' vectors, summed in doubles from the left. Few vectors are held at once."""
    last = None
    for at in range(0, len(sentences), HELD):
        v = unit_vectors(model, sentences[at : at + HELD], batch).astype(np.float64)
        v = v if last is None else np.concatenate([last, v])
        yield from np.cumsum(v[:-1] * v[1:], axis=1)[:, -1].tolist() if v.shape[1] else [0.0] * (len(v) - 1)
        last = v[-1:]


def _breaks(sims: list[float], k: float) -> list[bool]:
    """``find_breakpoints`` for the similarities of one section, with Spark's way of taking mean and deviation."""
    total = mean = m2 = 0.0
    for n, x in enumerate(sims, 1):
        total += x
        delta = x - mean
        mean += delta / n
        m2 += delta * (delta - delta / n)
    if not sims:
        return []
    limit = _rounded(total / len(sims) - k * math.sqrt(m2 / len(sims)))
    return [x < limit for x in sims]


def _cut(sections: list[list[str] | None], model: Callable, k: float, batch: int) -> list[list[tuple[str, int, int]] | None]:
    """The parts of each section, given its sentences: text, and the characters before it and up to its end."""
    sims = _neighbours(model, [s for section in sections if section for s in section], batch)
    out: list[list[tuple[str, int, int]] | None] = []
    first = True
    for section in sections:
        if not section:
            out.append(None if section is None else [])
            continue
        if not first:
            next(sims)  # of the last sentence of one section with the first one of another
        first = False
        at, upto, parts = 0, 0, []
        for n, ends in enumerate([*_breaks([_rounded(next(sims)) for _ in section[1:]], k), True], 1):
            if ends:
                text = " ".join(section[at:n])
                parts.append((text, upto, upto + len(text) + 1))
                at, upto = n, upto + len(text) + 1
        out.append(parts)
    return out


def semantic_split(
    sections: DataFrame, max_size: int | None = 1000, k: float | None = 1.5, loader: Callable[[], Callable] | None = None, split: Callable[[Column], Column] = T.split_sentences
) -> DataFrame:
    """Sections (source, section_seq, headings, text, start_off, end_off) longer than ``max_size`` are cut
    at breakpoints; others pass. Adds ``part``; parts inherit the section's columns, and their offsets
    share out the section's range by length. ``split`` makes a text's sentences, for example by learned ``Borders``.

    A section is one row, so its sentences are compared where it lies, as ``split_vectors`` would: nothing is shuffled, and
    vectors do not leave the Python worker."""
    max_size, k = max_size or 1000, k or 1.5
    batch = 32 if loader else HELD  # rows of the default do not depend on each other

    # The fixed rules are applied in the Python worker, which has the text.
    fixed = split is T.split_sentences
    given = F.when(F.length("text") > max_size, F.lit(True) if fixed else split(F.col("text")))
    read = sections.withColumn("_sentences", given)
    names, at = sections.columns, sections.columns.index("text")
    schema = sections.withColumn("part", F.lit(0)).withColumn("_before", F.lit(0).cast("long")).withColumn("_upto", F.lit(0).cast("long")).schema
    for field in schema[-3:]:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader() if loader else hash_embed
        for rows in batches:
            texts, own = rows.column(at), rows.column(len(names)).to_pylist()
            cut = _cut([sentences(texts[n].as_py()) if s else None for n, s in enumerate(own)] if fixed else own, model, k, batch)
            # A section that passes is its own only part.
            parts = [[(texts[n].as_py(), None, None)] if p is None else p for n, p in enumerate(cut)]
            of = pa.array([n for n, p in enumerate(parts) for _ in p], pa.int64())
            text, before, upto = ([x[c] for p in parts for x in p] for c in range(3))
            columns = [rows.column(c).take(of) for c in range(len(names))]
            columns[at] = pa.array(text, pa.string())
            numbers = pa.array([n for p in parts for n in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, numbers, pa.array(before, pa.int64()), pa.array(upto, pa.int64())], [*names, "part", "_before", "_upto"])

    parts = read.mapInArrow(run, schema)
    stop = F.when(F.col("_upto").isNull(), F.col("end_off")).otherwise(F.least(F.col("end_off"), F.col("start_off") + F.col("_upto")))
    start = F.when(F.col("_upto").isNull(), F.col("start_off")).otherwise(F.least(stop, F.col("start_off") + F.col("_before")))
    new = {"start_off": start, "end_off": stop}
    return parts.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names], "part")
