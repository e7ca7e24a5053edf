"""Licence scans: a paragraph classifier confirmed by templates.

A multinomial logistic regression on hashed word one- to three-grams, trained here on the
labelled templates below, on licences outside the families and on prose, gives each
licence family, ``unknown`` and ``prose`` a probability; its temperature is calibrated on
variants that the training hasn't seen.  A family counts when its probability reaches
``MIN_PROBABILITY`` and a template of the family confirms it: enough of the template's
word pairs stand in the paragraph.  Any other paragraph that is a licence with a
probability of ``MIN_LICENCE`` is of the family ``unknown``.

A paragraph is found around the word pairs that it shares with a template: pairs at most
``GAP`` words apart with no blank line between them, and up to ``MARGIN`` words of their
lines on each side.  Lines are joined, so a wrapped notice is one paragraph, and comment
signs aren't words; a line that confirms another family by itself counts beside it.  Pairs
are found by hashes over whole batches, and the classifier sees nothing else.

Defined results: null, empty and blank texts have no licence.  A document has one row
for each of its families.  Repeated rows of documents give their rows each.  Ties go to
the family first in the alphabet.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import PUNCTUATION, slices, split_words, window_hashes

BUCKETS = 1 << 14
MIN_PROBABILITY = 0.6
MIN_COVERAGE = 0.6
MIN_LICENCE = 0.8
GAP, MARGIN = 12, 8
VARIANTS = 24
STEPS = 300
UNKNOWN, PROSE = "unknown", "prose"

# Labelled templates: a family, then a notice or a passage that marks its licence.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("agpl", "Released under the GNU AGPL version 3"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "Licensed under the GNU General Public License version 3"),
    ("gpl", "Released under the GPL version 2 or later"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Licensed under the ISC License"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("lgpl", "Released under the GNU LGPL version 3"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "Licensed under the Mozilla Public License 2.0"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "This document is confidential and proprietary and may not be copied or distributed without written permission"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("public-domain", "The person who associated a work with this deed has dedicated the work to the public domain CC0 1.0 Universal"),
)
# Licences outside the families, and forms that name one; NAME stands for a name.
OUTSIDE = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "You may distribute this package under the terms of the Artistic License",
    "Licensed under the NAME License", "Released under the NAME License", "Licensed under the NAME Public License version 1", "SPDX-License-Identifier: NAME",
    "This file is distributed under the terms of the NAME License", "The source code is made available under the NAME open source license",
)
# Labelled prose: what looks like a licence by a word or two, and what doesn't.
OTHERS = (
    "the driver had no licence for the car and the police took the plate", "you can use this road except in winter", "the software was released in spring and sold well",
    "he studied at MIT and then at Oxford", "the apache helicopter was distributed to several bases", "all copies of the book were sold", "rights of way are reserved for buses",
    "permission to enter was granted by the guard", "the following conditions were met by the team", "the public domain of the town lies by the river", "a version of the story with or without the ending",
    "this work is hard and under the sun it is harder", "terms of the treaty were modified in Geneva", "a notice on the door said that the shop was closed", "the general public was let in for free",
    "she kept a copy of the letter in her desk", "under the bridge they met again", "creative people share what they know", "it is provided that the weather is fine", "free of charge parking is behind the house",
)
FAMILIES = sorted({f for f, _ in TEMPLATES})
CLASSES = [*FAMILIES, UNKNOWN, PROSE]


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.lower())


def features(words: list[str]) -> np.ndarray:
    """Distinct buckets of the word one-, two- and three-grams."""
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.unique(np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int64))


def _variants(seed: int, count: int) -> list[tuple[list[str], int]]:
    """Training paragraphs: templates with words lost, changed and put around them, and prose."""
    rng = random.Random(seed)
    filler = [w for text in OTHERS for w in tokens(text)] + ["".join(rng.choices("aeinorst", k=rng.randint(2, 7))) for _ in range(400)]
    out = []
    for label, text in [(CLASSES.index(f), t) for f, t in TEMPLATES] + [(CLASSES.index(UNKNOWN), t) for t in OUTSIDE for _ in (0, 1)] + [(CLASSES.index(PROSE), t) for t in OTHERS]:
        for _ in range(count):
            name = "".join(rng.choices("abcdefghiklmnoprstuvwz", k=rng.randint(2, 9)))
            words = [w for w in tokens(text.replace("NAME", name)) if rng.random() > 0.06]
            if label == len(CLASSES) - 1:
                rng.shuffle(words)
            around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 2, 6, 15)))]
            at = rng.randint(0, len(around))
            out.append((around[:at] + words + around[at:], label))
    for _ in range(12 * count):
        out.append(([rng.choice(filler) for _ in range(rng.randint(1, 60))], len(CLASSES) - 1))
    return out


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, words: list[str]) -> np.ndarray:
        f = features(words)
        z = (self.bias + self.weights[f].sum(0) / np.sqrt(max(len(f), 1))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


@cache
def classifier(steps: int = STEPS) -> Classifier:
    """Trained by Adam on one set of variants; the temperature is the likeliest for another."""
    rows = _variants(1, VARIANTS)
    found = [features(w) for w, _ in rows]
    label = np.array([y for _, y in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    col = np.concatenate(found)
    scale = np.array([1 / np.sqrt(max(len(f), 1)) for f in found])
    used, col = np.unique(col, return_inverse=True)
    w, b = np.zeros((len(used), len(CLASSES))), np.zeros(len(CLASSES))
    order = np.argsort(col, kind="stable")
    begin = np.searchsorted(col[order], np.arange(len(used)))
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        z = b + np.add.reduceat(w[col], starts) * scale[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), label] -= 1
        p /= len(rows)
        grads = (np.add.reduceat((p * scale[:, None])[row[order]], begin) + 1e-6 * w, p.sum(0))
        for i, (value, grad) in enumerate(zip((w, b), grads, strict=True)):
            m, u = state[2 * i], state[2 * i + 1]
            m += 0.1 * (grad - m)
            u += 0.01 * (grad**2 - u)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-9)
    full = np.zeros((BUCKETS, len(CLASSES)))
    full[used] = w
    held = _variants(2, 6)

    def loss(t: float) -> float:
        model = Classifier(full, b, t)
        return -sum(float(np.log(model.probabilities(words)[y] + 1e-12)) for words, y in held)

    return Classifier(full, b, min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


_TEMPLATE_PAIRS = [(f, _pairs(tokens(t))) for f, t in TEMPLATES]


def coverage(words: list[str], family: str) -> float:
    """The largest share of a template's word pairs that stand in the paragraph."""
    mine = _pairs(words)
    return max(len(mine & pairs) / len(pairs) for f, pairs in _TEMPLATE_PAIRS if f == family)


def classify(paragraph: str, model: Classifier | None = None) -> tuple[str, float, float]:
    """Family, its probability and the coverage of its template; the family is ``prose`` for anything else."""
    words = tokens(paragraph)
    p = (model or classifier()).probabilities(words)
    best = int(p[: len(FAMILIES)].argmax())
    family, cover = FAMILIES[best], coverage(words, FAMILIES[best])
    if p[best] >= MIN_PROBABILITY and cover >= MIN_COVERAGE:
        return family, float(p[best]), cover
    if 1 - p[-1] >= MIN_LICENCE:
        return UNKNOWN, float(1 - p[-1]), cover
    return PROSE, float(p[-1]), cover


def verdicts(lines: list[str], model: Classifier | None = None) -> list[tuple[str, float, float]]:
    """What a paragraph of these lines is: its family as a whole, and others that one of its lines confirms."""
    whole = classify(" ".join(lines), model)
    own = [v for v in (classify(x, model) for x in lines) if v[0] in FAMILIES] if len(lines) > 1 else []
    if whole[0] in FAMILIES:
        return [whole] + [v for v in own if v[0] != whole[0]]
    return own or [whole] * (whole[0] != PROSE)


@cache
def _seeds() -> np.ndarray:
    w = split_words(pa.array([t for _, t in TEMPLATES] + [part for t in OUTSIDE for part in t.split("NAME")]), PUNCTUATION)
    pairs = window_hashes(w.hashes(lower=True), 2)
    inside = np.ones(len(pairs), bool)
    inside[w.first[1:-1][w.first[1:-1] < len(w.starts)] - 1] = False  # not across templates
    return np.unique(pairs[inside])


#: A line without a word: what is between its ends is no letter, digit or byte of a longer character.
BLANK = re.compile(rb"\n[^0-9A-Za-z\x80-\xff\n]*\n")


def candidates(col: pa.Array) -> dict[int, list[list[str]]]:
    """For each row the lines of each paragraph that shares a word pair with a template."""
    w = split_words(col, PUNCTUATION)
    pairs = window_hashes(w.hashes(lower=True), 2)
    seeds = _seeds()
    hit = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, pairs), len(seeds) - 1)] == pairs)
    rows = np.searchsorted(w.first, hit, "right") - 1
    hit, rows = hit[hit + 1 < w.first[rows + 1]], rows[hit + 1 < w.first[rows + 1]]
    out: dict[int, list[list[str]]] = {}
    raw = w.data.tobytes()
    runs: list[list[int]] = []  # row, first word, last word
    for at, row in zip(hit.tolist(), rows.tolist(), strict=True):
        now = runs[-1] if runs and runs[-1][0] == row else None
        if BLANK.search(raw, int(w.ends[at]), int(w.starts[at + 1])):
            continue  # a pair across paragraphs
        if now and at - now[2] <= GAP and not BLANK.search(raw, int(w.ends[now[2]]), int(w.starts[at])):
            now[2] = at + 1
        else:
            runs.append([row, at, at + 1])
    for row, low, high in runs:
        head, tail = max(low - MARGIN, int(w.first[row])), min(high + MARGIN, int(w.first[row + 1]) - 1)
        begin = max(int(w.starts[head]), raw.rfind(b"\n", int(w.starts[head]), int(w.starts[low])) + 1)
        end = raw.find(b"\n", int(w.ends[high]), int(w.ends[tail]))
        end = int(w.ends[tail]) if end < 0 else end
        out.setdefault(row, []).append([x for x in raw[begin:end].decode().split("\n") if tokens(x)])
    return out


FOUND = "doc_id long, family string, n_paragraphs long, probability double, coverage double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document and licence family: paragraphs, and the best probability and coverage among them."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(classifier())  # 2 MB, trained once

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows = part.column("doc_id").to_pylist(), []
                for row, found in candidates(part.column("text")).items():
                    mine: dict[str, list] = {}
                    for family, p, cover in (v for lines in found for v in verdicts(lines, shared.value)):
                        now = mine.setdefault(family, [0, 0.0, 0.0])
                        now[:] = now[0] + 1, max(now[1], p), max(now[2], cover)
                    rows += [(ids[row], family, *now) for family, now in sorted(mine.items())]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "family", "n_paragraphs", "probability", "coverage"])

    return picked.mapInArrow(run, FOUND)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
