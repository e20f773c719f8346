"""Licence scan by a trained paragraph classifier (operator 9).

Paragraphs are runs of lines that are not blank.  A multinomial logistic
regression over hashed one- to three-word n-grams tells licence families and
``unknown`` apart.  It is trained on the notices below, varied, against a
bounded sample of the corpus' own lines and some near misses.  Its
probabilities are calibrated by a temperature fitted on folds it was not
trained on.

Every paragraph is read whole, in overlapping windows: for each template one
from each of its word pairs on, as long as the template and ``CONTEXT`` words
on both sides.  A family is reported when a template confirms it (enough of
the template's word pairs, in share, occur in the window) and its calibrated
probability there, with ``CONTEXT`` words around, reaches
``MIN_PROBABILITY``.  Families of overlapping windows that are each confirmed
by the word pairs that the other's templates do not have stand side by side
and are judged without each other's classes; one that is not so confirmed
yields to a more probable one.  Each licence of an SPDX expression is read as
the tag and that licence.

Rows in, defined results: null and empty texts have no paragraph; repeated
rows are reported each; ties go to the first family by name; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.tokens import hash_strings, mix, ragged, slices, text_column, words

# fixed values: public licence notices by family
NOTICES = {
    "agpl": ("GNU Affero General Public License version 3",
             "This program is licensed under the GNU Affero General Public License, version 3.",
             "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Released under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "Dedicated to the public domain under CC0 1.0 Universal.",
            "This is free and unencumbered software released into the public domain."),
    "cc-by": ("Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License.",
            "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.",
                    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
NEAR_MISSES = (
    "She renewed her driving license at the office on Monday.", "The license plate was covered in mud.",
    "Apache helicopters flew over the valley.", "The public library is free and open to all.",
    "Students at MIT built a small robot.", "All rights and duties of the citizens are listed in the act.",
    "The general public was invited to the opening.", "A version of the song was released in 2003.",
    "The work is common and creative.", "The seats were reserved for the guests.",
    "You may not use this entrance.", "The software was sold with or without fee.",
)
FAMILIES = tuple(sorted(NOTICES))
#: Lines with these are no background.
LICENCE_WORDS = r"licen[cs]e|rights reserved|copyright|spdx|creative commons|\bcc by|public domain"
DIM = 1 << 13
SAMPLE_LINES = 800
VARIANTS = 24
FOLDS = 3
STEPS = 80
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.6
#: Words around a notice that training adds at most and windows take in.
CONTEXT = 5


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of lower-cased words without outer punctuation; ``1234`` and up read as a number.

    What is punctuation only (comment marks) is no word.
    """
    w = words(texts)
    if not len(w.vocab):
        return np.zeros(0, np.uint64), w.offsets
    bare = pc.replace_substring_regex(pc.utf8_lower(w.vocab), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    bare = pc.replace_substring_regex(bare, r"^\d{4,}$", "0000")
    real = (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)[w.ids]
    return hash_strings(bare)[w.ids[real]], np.concatenate([[0], np.cumsum(real)])[w.offsets]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(line, feature) of all one- to three-word n-grams."""
    return _code_grams(*_tokens(texts))


def _code_grams(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out_line, out_gram, gram = [], [], np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(3):
            n = max(len(code) - k, 0)
            gram = mix(gram[:n] * np.uint64(0x9E3779B97F4A7C15) + code[k:k + n] + np.uint64(k + 1))
            ok = np.arange(n) + k < off[doc[:n] + 1] if n else np.zeros(0, bool)
            out_line.append(doc[:n][ok])
            out_gram.append(gram[ok])
    return np.concatenate(out_line), np.concatenate(out_gram)


class Model(NamedTuple):
    weight: np.ndarray        # DIM x classes; the last class is unknown
    bias: np.ndarray
    temperature: float

    def margins(self, line: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """Mean weight of a line's n-grams plus bias (bounded rows at a time)."""
        out = np.zeros((n, len(self.bias)))
        size = np.bincount(line, minlength=n)
        order = np.argsort(line, kind="stable")
        l, cell = line[order], (gram[order] % np.uint64(DIM)).astype(np.int64)
        for k in range(0, len(l), 1 << 18):
            part = l[k:k + (1 << 18)]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            out[part[edge]] += np.add.reduceat(self.weight[cell[k:k + (1 << 18)]], edge, axis=0)
        return out / np.maximum(np.sqrt(size), 1)[:, None] + self.bias

    def probabilities(self, line: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        z = self.margins(line, gram, n) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _train(line: np.ndarray, cell: np.ndarray, y: np.ndarray, classes: int, steps: int = STEPS) -> Model:
    """Softmax regression by Adam over sparse rows, each class weighing the same."""
    n = len(y)
    size = np.maximum(np.sqrt(np.bincount(line, minlength=n)), 1)
    share = 1.0 / np.maximum(np.bincount(y, minlength=classes), 1)
    row_weight = share[y] / classes
    w, b = np.zeros((DIM, classes)), np.zeros(classes)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    order = np.argsort(cell, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
    used = cell[order][edge]
    starts = np.searchsorted(line, np.arange(n))
    full = np.flatnonzero(np.bincount(line, minlength=n))
    for t in range(1, steps + 1):
        z = np.tile(b, (n, 1))
        z[full] += np.add.reduceat(w[cell], starts[full], axis=0) / size[full, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= row_weight[:, None]
        gw = np.zeros_like(w)
        gw[used] = np.add.reduceat((p / size[:, None])[line[order]], edge, axis=0)
        for i, (x, g) in enumerate(((w, gw + 1e-5 * w), (b, p.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.2 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return Model(w, b, 1.0)


def examples(background: list[str], seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Varied notices and unknown lines with their class numbers."""
    rng = np.random.default_rng(seed)
    filler = [w for line in background[:400] for w in line.split()[:12]] or ["the", "page"]
    out, y = [], []

    def pad(n: int) -> list[str]:
        return [filler[i] for i in rng.integers(len(filler), size=n)]

    for c, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            for v in range(VARIANTS):
                w = notice.split()
                if v and len(w) > 8 and rng.random() < 0.5:
                    a = int(rng.integers(0, len(w) // 4))
                    w = w[a:len(w) - int(rng.integers(0, len(w) // 4))]
                if v and rng.random() < 0.5:
                    w = pad(int(rng.integers(0, 6))) + w + pad(int(rng.integers(0, 6)))
                text = " ".join(w)
                out.append(text.upper() if rng.random() < 0.1 else text)
                y.append(c)
    for line in [*background, *NEAR_MISSES * 20]:
        out.append(line)
        y.append(len(FAMILIES))
    return out, np.array(y)


def fit(background: list[str]) -> Model:
    """Train on all examples; the temperature comes from folds left out in turn."""
    texts, y = examples(background)
    line, gram = _grams(pa.array(texts, pa.large_string()))
    order = np.argsort(line, kind="stable")
    line, cell = line[order], (gram[order] % np.uint64(DIM)).astype(np.int64)
    classes = len(FAMILIES) + 1
    fold = np.arange(len(y)) % FOLDS
    margins = np.zeros((len(y), classes))
    for f in range(FOLDS):
        rows = np.flatnonzero(fold != f)
        new = np.full(len(y), -1)
        new[rows] = np.arange(len(rows))
        on = new[line] >= 0
        part = _train(new[line[on]], cell[on], y[rows], classes, STEPS // 2)
        left = ~on
        z = part.margins(line[left], cell[left].astype(np.uint64), len(y))
        margins[fold == f] = z[fold == f]
    share = 1.0 / np.maximum(np.bincount(y, minlength=classes), 1)[y]

    def loss(t: float) -> float:
        z = margins / t
        z = z - z.max(axis=1, keepdims=True)
        return float((share * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).sum())

    best = min(np.exp(np.linspace(np.log(0.3), np.log(10), 60)), key=loss)
    return _train(line, cell, y, classes)._replace(temperature=float(best))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(3) + mix(second))


def _pairs(texts: pa.Array) -> list[np.ndarray]:
    """Distinct word pairs of each line (single words for one-word lines)."""
    code, off = _tokens(texts)
    return [np.unique(_pair(code[a:b - 1], code[a + 1:b]) if b - a > 1 else code[a:b]) for a, b in zip(off, off[1:])]


class Found(NamedTuple):
    """A template that a window confirms: words ``start .. stop`` and the template's pairs in it."""

    family: int
    template: int
    start: int
    stop: int
    pairs: frozenset


class Templates:
    def __init__(self) -> None:
        self.of = {f: _pairs(pa.array(NOTICES[f], pa.large_string())) for f in FAMILIES}
        self.keys = np.unique(np.concatenate([t for f in FAMILIES for t in self.of[f]]))
        self.small = np.zeros(1 << 16, bool)
        self.small[self.keys >> np.uint64(48)] = True
        #: (family, pairs, words) of each template; pairs are numbers of ``keys``
        self.all = [(c, frozenset(np.searchsorted(self.keys, t).tolist()), int(n))
                    for c, f in enumerate(FAMILIES)
                    for t, n in zip(self.of[f], np.diff(_tokens(pa.array(NOTICES[f], pa.large_string()))[1]))]
        self.member = np.zeros((len(self.all), len(self.keys)), bool)
        for t, (_, pairs, _) in enumerate(self.all):
            self.member[t, list(pairs)] = True
        self.family_pairs = [frozenset().union(*(p for g, p, _ in self.all if g == c)) for c in range(len(FAMILIES))]
        self.tag, *self.joins = hash_strings(pa.array(["spdx-license-identifier", "or", "and", "with"]))
        self.tagged = np.array([_tokens(pa.array([t], pa.large_string()))[0][0] == self.tag
                                for f in FAMILIES for t in NOTICES[f]])

    def best(self, family: str, pairs: np.ndarray) -> float:
        """Largest share of a template of the family found in a paragraph."""
        return max(np.isin(t, pairs).mean() for t in self.of[family])

    def hits(self, code: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of the pair) of all template pairs that start at a word."""
        key = _pair(code[:-1], code[1:])
        at = np.flatnonzero(code == self.tag) + 2
        while len(at):                           # at: where a joining word may stand
            at = at[at + 1 < len(code)]
            at = at[np.isin(code[at], self.joins) & (paragraph[at + 1] == paragraph[at - 2])]
            key[at] = _pair(np.full(len(at), self.tag), code[at + 1])
            at = at + 2
        maybe = np.flatnonzero(self.small[key >> np.uint64(48)] & (paragraph[:-1] == paragraph[1:]))
        number = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        ok = self.keys[number] == key[maybe]
        return maybe[ok], number[ok]

    def confirmed(self, code: np.ndarray, paragraph: np.ndarray, min_template: float) -> list[Found]:
        """Windows in which enough of a template's pairs occur, cut to these pairs."""
        place, number = self.hits(code, paragraph)
        out = []
        for t, (family, pairs, n_words) in enumerate(self.all):
            need = max(1, int(np.ceil(min_template * len(pairs) - 1e-9)))
            own = self.member[t, number]
            at, num = place[own], number[own]
            if len(at) < need:
                continue
            last = len(at) - need + 1
            near = ((at[need - 1:] - at[:last] < n_words + 2 * CONTEXT)
                    & (paragraph[at[need - 1:]] == paragraph[at[:last]]))
            best: dict[int, Found] = {}          # by the last pair: the most pairs, then the shortest
            for i in np.flatnonzero(near).tolist():
                seen, stop, j = set(), i, i
                while j < len(at) and at[j] - at[i] < n_words + 2 * CONTEXT and paragraph[at[j]] == paragraph[at[i]]:
                    if num[j] not in seen:
                        seen.add(int(num[j]))
                        stop = j
                    j += 1
                if len(seen) >= need and (stop not in best or len(seen) >= len(best[stop].pairs)):
                    best[stop] = Found(family, t, int(at[i]), int(at[stop]) + 2, frozenset(seen))
            out.extend(best.values())
        return out


def judge(found: list[Found], p: np.ndarray, around: np.ndarray, templates: Templates, min_probability: float,
          min_template: float) -> list[tuple[Found, float]]:
    """Confirmed windows whose family is probable, with that probability (``around``: words looked at).

    Of a family's overlapping windows, the one with the largest share of its template stands for all.
    """
    order = sorted(range(len(found)), key=lambda i: (around[i, 0], i))
    near: list[list[int]] = [[] for _ in found]  # windows have few words, so few overlap
    for n, i in enumerate(order):
        for k in order[n + 1:]:
            if around[k, 0] >= around[i, 1]:
                break
            near[i].append(k)
            near[k].append(i)

    def apart(i: int, k: int) -> bool:
        """Is window i's template confirmed by the pairs that the family of window k does not have?"""
        left = templates.all[found[i].template][1] - templates.family_pairs[found[k].family]
        return bool(left) and len(found[i].pairs & left) >= min_template * len(left) - 1e-9

    others = [[k for k in near[i] if found[k].family != f.family] for i, f in enumerate(found)]
    beside = [{found[k].family for k in others[i] if apart(i, k) and apart(k, i)} for i in range(len(found))]
    chance = {i: p[i, f.family] / max(1.0 - sum(p[i, g] for g in beside[i]), 1e-300) for i, f in enumerate(found)}
    taken: dict[int, float] = {}
    for i in sorted(range(len(found)), key=lambda i: (-chance[i], found[i].family, i)):
        before = [k for k in others[i] if k in taken]
        if all(apart(i, k) for k in before):
            seen = beside[i] | {found[k].family for k in before}
            value = float(p[i, found[i].family] / max(1.0 - sum(p[i, g] for g in seen), 1e-300))
            if value >= min_probability:
                taken[i] = min(value, 1.0)
    kept: set[int] = set()
    for i in sorted(taken, key=lambda i: (-len(found[i].pairs) / len(templates.all[found[i].template][1]), -taken[i], i)):
        f = found[i]
        if not any(k in kept and found[k].family == f.family and found[k].start < f.stop and f.start < found[k].stop
                   for k in near[i]):
            kept.add(i)
    return [(found[i], taken[i]) for i in sorted(kept)]


def sample_lines(docs: DataFrame, n: int = SAMPLE_LINES) -> list[str]:
    """About ``n`` distinct corpus lines without licence words, drawn by hash: the bounded background."""
    lines = (docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
             .filter("trim(line) <> ''"))
    total = lines.count()
    # a share of all lines by hash, wide enough that repeated and licence lines may fall out
    draw = F.pmod(F.xxhash64("line"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, 3 * n / max(total, 1))))
    drawn = lines.filter(draw).filter(~F.lower("line").rlike(LICENCE_WORDS)).distinct()
    return [r.line for r in drawn.orderBy(F.xxhash64("line"), "line").limit(n).collect()]


RESULT = "doc_id long, family string, paragraphs int, first_line int, probability double, template_share double"


def license_scan(docs: DataFrame, min_probability: float = MIN_PROBABILITY, min_template: float = MIN_TEMPLATE,
                 sample: int = SAMPLE_LINES) -> DataFrame:
    """One row per document and confirmed licence family."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample_lines(rows, sample)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, templates = shared.value, Templates()
        for batch in batches:
            for piece in slices(batch, limit=2 << 20):
                parts = pc.split_pattern(text_column(piece), "\n")
                off = parts.offsets.to_numpy().astype(np.int64)
                off = off - off[0]
                lines = parts.flatten()
                code, ends = _tokens(lines)
                blank = pc.binary_length(pc.utf8_trim_whitespace(lines)).to_numpy(zero_copy_only=False) == 0
                fresh = np.concatenate([[True], blank])[:len(lines)]
                fresh[off[:-1][off[:-1] < len(lines)]] = True
                paragraph = np.repeat(np.cumsum(fresh), np.diff(ends))
                found = templates.confirmed(code, paragraph, min_template) if len(code) > 1 else []
                if not found:
                    continue
                span = np.array([(f.start, f.stop) for f in found], np.int64)
                inside = paragraph[span[:, 0]]
                around = np.column_stack([
                    np.maximum(span[:, 0] - CONTEXT, np.searchsorted(paragraph, inside)),
                    np.minimum(span[:, 1] + CONTEXT, np.searchsorted(paragraph, inside, side="right"))])
                tagged = templates.tagged[[f.template for f in found]]
                around[tagged] = span[tagged]
                size = around[:, 1] - around[:, 0]
                looked = code[ragged(around[:, 0], size)]
                looked[(np.cumsum(size) - size)[tagged]] = templates.tag      # the tag and one licence
                line, gram = _code_grams(looked, np.concatenate([[0], np.cumsum(size)]))
                p = model.probabilities(line, gram, len(found))
                got: dict[tuple[int, int], list] = {}
                for f, chance in judge(found, p, around, templates, min_probability, min_template):
                    place = int(np.searchsorted(ends, f.start, side="right")) - 1
                    d = int(np.searchsorted(off, place, side="right")) - 1
                    r = got.setdefault((d, f.family), [set(), place - int(off[d]), 0.0, 0.0])
                    r[0].add(int(paragraph[f.start]))
                    r[1] = min(r[1], place - int(off[d]))
                    r[2], r[3] = max(r[2], chance), max(r[3], len(f.pairs) / len(templates.all[f.template][1]))
                if got:
                    keys = sorted(got)
                    values = [got[k] for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(pa.array([k[0] for k in keys])),
                         pa.array([FAMILIES[k[1]] for k in keys]), pa.array([len(v[0]) for v in values], pa.int32()),
                         pa.array([v[1] for v in values], pa.int32()), pa.array([v[2] for v in values]),
                         pa.array([v[3] for v in values])],
                        ["doc_id", "family", "paragraphs", "first_line", "probability", "template_share"])

    return rows.mapInArrow(scan, RESULT)
