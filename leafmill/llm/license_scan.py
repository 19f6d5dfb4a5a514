"""Licence scans: a trained paragraph classifier with template confirmation.

A notice may be one line, or be wrapped over several. Paragraphs are therefore lines, and windows of consecutive
words of the text, whatever lines they lie on. A window begins and ends with words of one template, holds the
share ``cover`` of its n-grams, and has at most ``STRETCH`` times the template's words and ``SLACK`` more, so that
some words may stand between. Marks of comments are no words; the words among them (``dnl``, ``rem``, ``c``) are
left out at the start of a line; a word broken by a hyphen at a line's end is joined where the templates know it.

A paragraph's features are its distinct word 1- and 2-grams (lower-cased words of
letters, digits, dots and hyphens) that occur in the templates. A multinomial logistic regression over
these sparse features, with a class ``unknown``, is trained on the templates, on parts of them, and on
``max_negatives`` paragraphs of the corpus that no template resembles. Its scores are calibrated by a
temperature fitted on held-out training rows. The class of greatest probability is the prediction; a family,
not ``unknown``, of probability ``least`` or more is confirmed by comparing the paragraph with that family's
templates: the share of some template's n-grams that it holds must reach ``cover``. No other family is tried. Whole texts are read, however
long. A finding's start and stop are those of the lines that it touches; findings of one family that share a line
are one; different families on one line are one finding each.

Scale: a map without a shuffle over whole texts. A line without one of the templates' anchor words
cannot reach the cover and is passed over by one regex search; windows are looked for only in texts that have
enough words of a template, around its 2-grams. The model (some thousand weights) is broadcast;
training reads a sample of at most about ``max_negatives`` texts.

Edge cases: null and empty texts have no licence; one row per finding in ``find_licences`` and one per
document in ``licence_report`` (n_licences 0, families empty); repeated rows get equal answers; an
empty table gives an empty result (the model is then trained without corpus negatives); other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices of public licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced or distributed without the prior written permission of the publisher."),
}
UNKNOWN = "unknown"
STRETCH = 2
SLACK = 8
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_BROKEN = re.compile(r"(?<=[a-z0-9])-[\x20\t\r]*\n")
_MARKS = frozenset(("dnl", "rem", "c"))


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _grams(tokens: list[str]) -> list[str]:
    return [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]


def _lowered(text: str) -> str:
    """Lower case with the text's own offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Classifier:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.source = templates
        self.families = [*templates, UNKNOWN]
        self.templates = [(self.families.index(f), frozenset(_grams(words(t)))) for f, ts in templates.items() for t in ts]
        self.index = {g: k for k, g in enumerate(sorted(set().union(*(g for _, g in self.templates))))}
        self.w = np.zeros((len(self.index) + 1, len(self.families)))
        self.temperature = 1.0

    def features(self, tokens: list[str]) -> list[int]:
        """Indices of the known n-grams, and that of the constant."""
        known = self.index
        return [*sorted({known[g] for g in _grams(tokens) if g in known}), len(known)]

    def _examples(self, negatives: list[str]) -> tuple[list[list[int]], np.ndarray]:
        rows, labels = [], []
        for label, ts in enumerate(self.source.values()):
            for t in ts:
                tokens = words(t)
                for size in (1.0, 0.8, 0.6):
                    n = max(3, round(size * len(tokens)))
                    for at in {0, (len(tokens) - n) // 2, max(0, len(tokens) - n)}:
                        rows.append(self.features(tokens[at : at + n]))
                        labels.append(label)
        for text in negatives:
            rows.append(self.features(words(text)))
            labels.append(len(self.families) - 1)
        # Single words of licence texts occur anywhere: alone they are no licence.
        for gram in sorted(self.index):
            if " " not in gram:
                rows.append(self.features([gram]))
                labels.append(len(self.families) - 1)
        return rows, np.array(labels)

    @staticmethod
    def held_rows(labels: np.ndarray) -> np.ndarray:
        held = np.zeros(len(labels), bool)
        for label in np.unique(labels):
            held[np.flatnonzero(labels == label)[4::5]] = True
        return held

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.stack([self.w[r].sum(axis=0) for r in rows])

    def fit(self, negatives: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Classifier:
        """Full-batch gradient descent with per-weight step sizes; every fifth row of each family only calibrates."""
        rows, labels = self._examples(negatives)
        held = self.held_rows(labels)
        x = np.zeros((len(rows), self.w.shape[0]))
        for k, r in enumerate(rows):
            x[k, r] = 1.0
        x = x[~held]
        want = np.eye(len(self.families))[labels[~held]]
        weight = 1.0 / np.bincount(labels[~held], minlength=len(self.families))[labels[~held]]
        weight /= weight.sum()
        past = np.full_like(self.w, 1e-8)
        for _ in range(rounds):
            s = x @ self.w
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            grad = x.T @ ((p - want) * weight[:, None]) + decay * self.w
            past += grad * grad
            self.w -= rate * grad / np.sqrt(past)
        s = self._scores([r for r, h in zip(rows, held, strict=True) if h])
        own = labels[held]

        def loss(t: float) -> float:
            z = s / t
            return float((np.logaddexp.reduce(z, axis=1) - z[np.arange(len(own)), own]).mean())

        self.temperature = min(np.linspace(0.5, 3.0, 26), key=loss)
        return self

    def classify(self, paragraph: str, least: float, cover: float) -> tuple[str, float, float] | None:
        """(family, probability, template cover) of a paragraph that is a licence notice."""
        return self.classify_words(words(paragraph), least, cover)

    def classify_words(self, tokens: list[str], least: float, cover: float) -> tuple[str, float, float] | None:
        rows = self.features(tokens)
        if len(rows) < 3:
            return None
        s = self.w[rows].sum(axis=0) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(np.argmax(p))
        if self.families[best] == UNKNOWN or p[best] < least:
            return None
        held = set(_grams(tokens))
        share = max(len(held & t) / len(t) for f, t in self.templates if f == best)
        return (self.families[best], float(p[best]), share) if share >= cover else None


class Notices:
    """Finds the notices of a text by a model and settings."""

    def __init__(self, model: Classifier, least: float, cover: float):
        self.model, self.least, self.cover = model, least, cover
        self.cue = re.compile("|".join(sorted(map(re.escape, anchors(model, cover)))))
        self.parts = []
        self.pairs: dict[tuple[str, str], list[int]] = {}
        for k, (_, grams) in enumerate(model.templates):
            single = frozenset(g for g in grams if " " not in g)
            need = math.ceil(cover * len(grams) - 1e-9)
            fewest = need - (len(grams) - len(single))
            # One word more than it has 2-grams, or some words twice: the words of a template are this many at most.
            width = STRETCH * max(len(single), len(grams) - len(single) + 1) + SLACK
            self.parts.append((grams, single, need, fewest, width))
            for g in grams - single:
                self.pairs.setdefault(tuple(g.split(" ")), []).append(k)
        self.known = frozenset().union(*(single for _, single, *_ in self.parts))

    def _stream(self, low: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The words of a text, and where they stand."""
        tokens, at = [], []
        for m in _WORD.finditer(low):
            word, (start, stop) = m[0], m.span()
            if word in _MARKS and not low[low.rfind("\n", 0, start) + 1 : start].strip():
                continue
            if at and low[at[-1][1] : at[-1][1] + 1] == "-" and low.count("\n", at[-1][1], start) == 1 and _BROKEN.match(low, at[-1][1]):
                whole = next((x for x in (f"{tokens[-1]}-{word}", tokens[-1] + word) if x in self.known), None)
                if whole:
                    tokens[-1], at[-1] = whole, (at[-1][0], stop)
                    continue
            tokens.append(word)
            at.append((start, stop))
        return tokens, at

    def _windows(self, tokens: list[str], k: int, hits: list[int]) -> list[tuple[int, int]]:
        """(first, last) words of the windows that hold enough of template ``k``, whose 2-grams begin at ``hits``:
        those with most n-grams first, then the shortest; not overlapping."""
        grams, single, need, _, width = self.parts[k]
        most = max(1, need - len(single))
        zones: list[list[int]] = []
        for a, b in zip(hits, hits[most - 1 :], strict=False):
            if b + 2 - a <= width:
                start, stop = max(0, b + 2 - width), min(len(tokens), a + width)
                if zones and start <= zones[-1][1]:
                    zones[-1][1] = stop
                else:
                    zones.append([start, stop])
        found = []
        for start, stop in zones:
            places = [i for i in range(start, stop) if tokens[i] in single]
            for n, s in enumerate(places):
                seen: set[str] = set()
                best, last = 0, s
                for e in places[n:]:
                    if e - s >= width:
                        break
                    seen.add(tokens[e])
                    if e > s and (g := f"{tokens[e - 1]} {tokens[e]}") in grams:
                        seen.add(g)
                    if len(seen) > best:
                        best, last = len(seen), e
                if best >= need:
                    found.append((-best, last - s, s))
        taken = bytearray(len(tokens))
        out = []
        for _, more, s in sorted(found):
            if not any(taken[s : s + more + 1]):
                taken[s : s + more + 1] = b"\1" * (more + 1)
                out.append((s, s + more))
        return out

    def _wrapped(self, low: str) -> Iterator[tuple[tuple[str, float, float], int, int]]:
        have = self.known.intersection(_WORD.findall(low))
        broken = _BROKEN.search(low)
        if not broken and not any(len(have & single) >= fewest for _, single, _, fewest, _ in self.parts):
            return
        tokens, at = self._stream(low)
        hits: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)):
            if pair in self.pairs:
                for k in self.pairs[pair]:
                    hits.setdefault(k, []).append(i)
        for k, own in hits.items():
            for s, e in self._windows(tokens, k, own):
                if hit := self.model.classify_words(tokens[s : e + 1], self.least, self.cover):
                    stop = low.find("\n", at[e][1])
                    yield hit, low.rfind("\n", 0, at[s][0]) + 1, len(low) if stop < 0 else stop

    def __call__(self, text: str) -> list[dict]:
        low = _lowered(text)
        if not self.cue.search(low) and not _BROKEN.search(low):
            return []
        hits = list(self._wrapped(low))
        at = 0
        for line in text.split("\n"):
            if self.cue.search(low, at, at + len(line)) and (hit := self.model.classify(line, self.least, self.cover)):
                hits.append((hit, at, at + len(line)))
            at += len(line) + 1
        out: dict[str, list[dict]] = {}
        for (family, p, share), start, stop in sorted(hits, key=lambda h: h[1:]):
            own = out.setdefault(family, [])
            if own and start < own[-1]["stop"]:
                last = own[-1]
                last.update(probability=max(last["probability"], p), cover=max(last["cover"], share), stop=max(last["stop"], stop))
            else:
                own.append({"family": family, "probability": p, "cover": share, "start": start, "stop": stop})
        return sorted((f for own in out.values() for f in own), key=lambda f: (f["start"], f["stop"], f["family"]))


def train(docs: DataFrame, max_negatives: int = 2000, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Classifier:
    """Fit on the templates and on paragraphs (at most ``max_negatives``) of a hash-picked sample of the
    corpus that share at most two n-grams with any template: of each sampled text its longest line, of which the
    known n-grams are all that a feature needs."""
    model = Classifier(templates)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    total = rows.count()
    if total > max_negatives:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(10_000_000)) < int(10_000_000 * max_negatives / total))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                known = sorted({g for g in _grams(words(max(text.split("\n"), key=len))) if g in model.index})
                if len(known) <= 2:
                    out.append(" zzz ".join(known))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])

    lines = sorted(rows.select("text").mapInArrow(pick, "line string").toArrow()["line"].to_pylist())[:max_negatives]
    return Classifier(templates).fit(lines)


FOUND = "array<struct<family:string,probability:double,cover:double,start:int,stop:int>>"


def find_licences(docs: DataFrame, model: Classifier, least: float = 0.9, cover: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, found (notices in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = Notices(sent.value, least, cover)
        for batch in batches:
            out = [notices(text) if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, found)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, found {FOUND}")


def anchors(model: Classifier, cover: float) -> set[str]:
    """Words such that a paragraph holding ``cover`` of a template's n-grams must hold one of them: of
    each template the longest words, as many as could be missing and one more."""
    out: set[str] = set()
    for _, grams in model.templates:
        single = sorted((g for g in grams if " " not in g), key=lambda g: (-len(g), g))
        missing = int((1 - cover) * len(grams) + 1e-9)
        out |= set(single[: missing + 1])
    return out


def licence_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licences, families (distinct, sorted, comma-joined), spans (family:start:stop)."""
    one = lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["stop"].cast("string"))
    return find_licences(docs, train(docs)).select(
        "doc_id",
        F.size("found").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found")["family"])), ",").alias("families"),
        F.array_join(F.transform("found", one), ",").alias("spans"),
    )
