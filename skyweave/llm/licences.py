"""Licence scans by a trained paragraph classifier (operator 6).

Texts are cut at line ends and between sentences. Classified are these pieces, the sentences
of a paragraph that go over several lines, with the lines joined, and windows over what is
long; a paragraph ends at a line without words. Every unit goes to the classifier: logistic
regression on hashed word n-grams, with a class for each licence family and one for all else.

It is trained here, on the templates below and variants of them (words left out, put in
front or behind), against a bounded sample of NEGATIVES lines of the corpus (but those that
hold a template), denials of each template, notices of invented licences and texts that
only speak of licences. A temperature calibrates the probabilities: it is fitted on wordings
that training did not see, by leaving out a third of each family's templates three times. The
class of all else is chosen unless a family reaches CERTAIN. A prediction counts if it is
confirmed by comparison with the family's templates: the unit has CONFIRM of the word pairs
of one of them, and of its words that no other family has. What adds nothing at the ends of
a unit is left out of its span; of units that overlap the one most like its template stays.

Long texts are read in whole. Defined results: a null text counts as empty and has no
licences; repeated rows are judged alike, of spans equally like a template the shorter, then
the first one stays; on an empty table the classifier is trained without lines of the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, map_rows, slices, table, threshold
from .shingles import mixed

#: Wordings of licence notices, by family; fixed values.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "licensed under the AGPL", "This code is AGPLv3", "licensed under the GNU Affero General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0"],
    "apache": ["Apache License", "Apache License 2.0", "Apache-2.0 license", "Distributed under the Apache License", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "released under the terms of the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["BSD License", "BSD-3-Clause license", "BSD-2-Clause license", "3-clause BSD license", "Licensed under the BSD License", "released under the 3-clause BSD license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["Licensed under CC BY 4.0", "Available under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Available under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Available under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Licensed under CC0 1.0", "dedicated to the public domain under CC0", "dedicated to the public domain under the Creative Commons Zero license", "To the extent possible under law, the author has waived all copyright and related rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    "epl": ["Eclipse Public License", "Licensed under the Eclipse Public License, Version 2.0", "made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["GNU General Public License", "GNU GPL license", "Distributed under the GPL", "This code is GPLv3", "This code is GPLv2", "licensed under GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "licensed under the GNU GPL version 2 or later license", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["ISC License", "Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "lgpl": ["GNU Lesser General Public License", "licensed under the LGPL", "This library is LGPLv3", "licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["MIT License", "Distributed under the MIT License", "Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl": ["Mozilla Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense", "released under the Unlicense license", "SPDX-License-Identifier: Unlicense"],
}
#: Texts that speak of licences or of their names and give none; fixed values.
NEAR_MISSES = [
    "You need a driver's license to rent a car.", "The licensed premises close at eleven.", "A fishing license is required under the law.", "She works under licence as a nurse.", "The license fee is due in April.",
    "The Apache helicopter was released in version two.", "He studied at MIT and was released in May.", "All rights reserved.", "Copyright holders may apply for a hearing.", "The software license agreement is confidential.",
    "This product is licensed to the registered user only.", "The public gave general support to the new law.", "Permission to enter is granted by the guard.", "The eclipse was seen by the public.", "The warranty does not cover this work.",
    "Copyright (c) 2020 Someone. All rights reserved.", "No license is granted.", "The license has expired.", "Your license plate is 2.0 years old.", "Mozilla is a public company under general terms.",
]
#: Notices of licences that do not exist; {x} is a made-up word, {n} a number.
INVENTED = [
    "Licensed under the {x} License, Version {n}", "Released under the {x} License", "SPDX-License-Identifier: {x}-{n}.0", "This work is licensed under the {x} Public License", "distributed under the terms of the {x} license", "{x} License",
    "This code is {x}v{n}", "Distributed under the {x}", "GNU {x} License", "licensed under the {x}", "Available under {x} {n}.0",
]
#: What stands before the name of a licence in a notice, in templates that are the name alone; fixed values.
#: Then what denies a notice: in front of its first word of GIVES, or else of the whole.
CARRIERS = ["under the", "is under the", "licensed under the", "is released under the", "available under the terms of the", "is distributed under the", "subject to the", "covered by the", "this project uses the", "see the"]
DENIALS = ["not", "never", "no longer", "is not", "isn't", "cannot be", "neither", "was never", "nothing here is", "none of this is", "nothing is"]
GIVES = ("licensed", "released", "distributed", "available", "granted", "dedicated", "permitted", "made", "gplv3", "gplv2", "agplv3", "lgplv3")
ALL_ELSE = "unknown"
CLASSES = (ALL_ELSE, *sorted(TEMPLATES))
WIDTH = 1 << 15
GRAMS = (1, 2, 3)
NEGATIVES = 3000
VARIANTS = 60
CERTAIN = 0.6
#: The least share of a template's word pairs, and of its own words.
CONFIRM = 0.6
#: Words of a window, and of what is not cut into windows; pieces of more than two short windows are cut into these too.
SHORT, WINDOW, LONG = 12, 40, 60

_TOKEN = re.compile(r"\w+(?:[+.]+\w+)*")
_END = re.compile(r"[.!?](?=\s+[\"“(]?[A-ZÀ-Þ])")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("licence", "license"))


class Hashes(dict):
    """Hashes of words; the first half a million of no more than 64 letters are remembered."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000 and len(word) <= 64:
            self[word] = found
        return found


def places(words: list[str], known: Hashes) -> list[np.ndarray]:
    """For each of GRAMS, the feature of the n-gram that begins at each word; the last ones of a text begin none."""
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out, run = [], np.zeros(len(h), dtype=np.uint64)
    for k, n in enumerate(GRAMS):
        m = len(h) - n + 1
        run = mixed(run[: max(0, m)] + h[n - 1 :] * _ODD[k]) if m > 0 else run[:0]
        out.append((run % np.uint64(WIDTH)).astype(np.int64))
    return out


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


_WORDS = {family: [tokens(t) for t in texts] for family, texts in TEMPLATES.items()}
_OWN = {f: {w for t in texts for w in t} - {w for g, others in _WORDS.items() if g != f for t in others for w in t} for f, texts in _WORDS.items()}
_PAIRS = {family: [(pairs(t), set(t) & _OWN[family]) for t in texts] for family, texts in _WORDS.items()}


def likeness(words: list[str], family: str) -> float:
    """The largest share of the word pairs of one of the family's templates whose own words the unit has, to a share of CONFIRM."""
    own, every = pairs(words), set(words)
    return max(len(own & p) / len(p) if len(w & every) >= CONFIRM * len(w) else 0.0 for p, w in _PAIRS[family])


def gain(words: list[str], family: str) -> float:
    """How many word pairs of the family's templates a unit has: what is left out of its span has none."""
    own = pairs(words)
    return max(len(own & p) for p, _ in _PAIRS[family])


@dataclass
class Piece:
    start: int
    end: int
    first: int  # words [first, last) of the text
    last: int
    paragraph: int
    closed: bool


def pieces(text: str) -> tuple[list[Piece], list[str]]:
    """Lines, cut between sentences, and all words."""
    out: list[Piece] = []
    words: list[str] = []
    at = paragraph = 0
    for line in text.split("\n"):
        begin, before = 0, len(words)
        for end in [*(m.end() for m in _END.finditer(line)), len(line)]:
            part = line[begin:end]
            first = len(words)
            words += tokens(part)
            if len(words) > first:
                out.append(Piece(at + begin, at + end, first, len(words), paragraph, part.rstrip()[-1:] in ".!?"))
            begin = end
        if len(words) == before:
            paragraph += 1
        at += len(line) + 1
    return out, words


def units(found: list[Piece]) -> list[tuple[int, int, int, int]]:
    """(first piece, last piece, first word, last word): pieces, sentences over several lines, and windows over long ones."""
    out = []
    begin = 0
    for i, piece in enumerate(found):
        if piece.last - piece.first <= LONG:
            out.append((i, i, piece.first, piece.last))
        else:
            out.extend((i, i, a, min(a + WINDOW, piece.last)) for a in range(piece.first, piece.last - WINDOW // 2, WINDOW // 2))
        if piece.last - piece.first > 2 * SHORT:
            out.extend((i, i, a, min(a + SHORT, piece.last)) for a in range(piece.first, piece.last - SHORT // 2, SHORT // 2))
        if piece.closed or i + 1 == len(found) or found[i + 1].paragraph != piece.paragraph:
            if i > begin:
                out.extend(_joined(found, begin, i))
            begin = i + 1
    return out


def _joined(found: list[Piece], begin: int, end: int):
    """A sentence of several pieces; of a long one, from each piece on what has WINDOW words or just more."""
    if found[end].last - found[begin].first <= LONG:
        yield begin, end, found[begin].first, found[end].last
        return
    last = begin
    for i in range(begin, end):
        last = max(last, i + 1)
        while last < end and found[last].last - found[i].first < WINDOW:
            last += 1
        if found[last].last - found[i].first <= 2 * LONG:
            yield i, last, found[i].first, found[last].last


@dataclass
class Classifier:
    weights: np.ndarray  # a row for each feature, the last one for the bias
    temperature: float

    def probabilities(self, words: list[str], spans: np.ndarray, known: Hashes) -> np.ndarray:
        """A row for each span (first, last) of words: sums of weights are differences of running sums, so spans may overlap."""
        at = places(words, known)
        total, count = np.zeros((len(spans), len(CLASSES))), np.zeros(len(spans))
        for n, feature in zip(GRAMS, at, strict=True):
            sums = np.zeros((len(feature) + 1, len(CLASSES)))
            np.cumsum(self.weights[feature], axis=0, out=sums[1:])
            last = np.maximum(spans[:, 0], spans[:, 1] - n + 1)
            first = np.minimum(spans[:, 0], len(feature))
            last = np.minimum(last, len(feature))
            total += sums[last] - sums[first]
            count += last - first
        z = (total / np.sqrt(np.maximum(1, count))[:, None] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def family(self, text: str) -> tuple[str, float] | None:
        """The family of the first notice of a text and its probability."""
        found = notices(self, text, Hashes())
        return found[0][2:] if found else None


def notices(model: Classifier, text: str, known: Hashes) -> list[tuple[int, int, str, float]]:
    """(start, end, family, probability) of the notices of a text."""
    found, words = pieces(text)
    if not words:
        return []
    every = units(found)
    p = model.probabilities(words, np.array([u[2:] for u in every], dtype=np.int64), known)
    best = p[:, 1:].argmax(axis=1) + 1
    sure = np.flatnonzero(p[np.arange(len(p)), best] >= CERTAIN)
    out = []
    for i in sure.tolist():
        family, (a, b, first, last) = CLASSES[best[i]], every[i]
        share = likeness(words[first:last], family)
        if share < CONFIRM:
            continue
        whole = gain(words[first:last], family)
        while a < b and gain(words[found[a + 1].first : last], family) >= whole:
            a += 1
            first = found[a].first
        while a < b and gain(words[first : found[b - 1].last], family) >= whole:
            b -= 1
            last = found[b].last
        out.append((-share, -whole, last - first, first, last, a, b, family, float(p[i, best[i]])))
    kept: list[tuple] = []
    for one in sorted(out):
        if all(one[4] <= k[3] or k[4] <= one[3] for k in kept):
            kept.append(one)
    return [(*_span(text, found, k), k[7], k[8]) for k in sorted(kept, key=lambda k: k[3])]


def _span(text: str, found: list[Piece], notice: tuple) -> tuple[int, int]:
    """Code points from the first piece to the last; of a window in one piece, its words."""
    _, _, _, first, last, a, b, *_ = notice
    if a != b or (found[a].first, found[a].last) == (first, last):
        return found[a].start, found[b].end
    inside = list(_TOKEN.finditer(text, found[a].start, found[a].end))
    return inside[first - found[a].first].start(), inside[last - 1 - found[a].first].end()


def _variants(rng: np.random.Generator, filler: list[str], wordings: dict[str, list[list[str]]], each: int = VARIANTS) -> list[tuple[list[str], int]]:
    """Words of notices with their classes: templates, with words left out and around them."""
    out = []
    some = lambda: [filler[i] for i in rng.integers(len(filler), size=rng.integers(0, 8))]
    for family, texts in wordings.items():
        for words in texts:
            for k in range(each):
                kept = words if k == 0 or len(words) < 6 else [w for w in words if rng.random() > 0.06]
                if k % 2 and not set(words) & {*GIVES, "spdx", "this", "permission", "redistribution"}:
                    kept = [*tokens(CARRIERS[k // 2 % len(CARRIERS)]), *kept]
                out.append(([*(some() if k % 4 in (1, 3) else []), *kept, *(some() if k % 4 in (2, 3) else [])], CLASSES.index(family)))
    return out


def _others(rng: np.random.Generator, filler: list[str], wordings: dict[str, list[list[str]]]) -> list[tuple[list[str], int]]:
    """Words of denials, invented licences and near misses."""
    out = []
    for words in (w for texts in wordings.values() for w in texts):
        at = next((i for i, w in enumerate(words) if w in GIVES), 0)
        out += [([*words[:at], *tokens(DENIALS[i]), *words[at:]], 0) for i in rng.permutation(len(DENIALS))[:5]]
        out += [([*tokens(f"{it} is {d}"), *([] if words[at] in GIVES else [["under", "the"], ["licensed", "under", "the"]][i % 2]), *words[at:]], 0) for it, i, d in (("this work", 0, "not"), ("the code", 1, "never"), ("it", 1, "not"), ("this", 0, "no longer"))]
    for _ in range(30):
        x = "".join(rng.choice(list("bcdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 5)))
        out += [([*(filler[i] for i in rng.integers(len(filler), size=rng.integers(0, 4))), *tokens(t.format(x=x, n=rng.integers(1, 10)))], 0) for t in INVENTED]
    return out + [(tokens(t), 0) for t in NEAR_MISSES for _ in range(8)]


def _learned(data: list[tuple[np.ndarray, int]], rng: np.random.Generator, turns: int = 5) -> np.ndarray:
    """Weights of a logistic regression, by AdaGrad."""
    weights = np.zeros((WIDTH + 1, len(CLASSES)), dtype=np.float32)
    squares = np.full_like(weights, 1e-2)
    bias = np.array([WIDTH])
    for _ in range(turns):
        for i in rng.permutation(len(data)):
            at, y = data[i]
            scale = 1 / np.sqrt(max(1, len(at)))
            z = weights[at].sum(axis=0) * scale + weights[-1]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            if np.abs(p).max() < 0.02:
                continue  # hardly anything to learn
            for where, g in ((np.unique(at), p * scale), (bias, p)):
                squares[where] += g * g
                weights[where] -= 0.3 * g / np.sqrt(squares[where])
    return weights


def _logits(weights: np.ndarray, data: list[tuple[np.ndarray, int]]) -> np.ndarray:
    return np.array([weights[at].sum(axis=0) / np.sqrt(max(1, len(at))) + weights[-1] for at, _ in data])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min((0.25 * 1.15**k for k in range(25)), key=loss)


def held_out(negatives: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Logits and classes of variants of wordings that training left out, in three turns, with a fifth of all else.

    Wordings are left out of which some own word is in another one: no classifier knows a name that it never saw.
    """
    rng, known = np.random.default_rng(seed), Hashes()
    negatives = _without_notices(negatives)
    filler = [w for t in negatives for w in tokens(t)] or ["the"]
    features = lambda data: [(np.concatenate(places(w, known)), y) for w, y in data if w]
    plain = features([(tokens(t), 0) for t in negatives])
    z, y = [], []
    for fold in range(3):
        seen = {f: [t for i, t in enumerate(texts) if i % 3 != fold] for f, texts in _WORDS.items()}
        named = {f: {w for t in seen[f] for w in t} & _OWN[f] for f in seen}
        left = {f: [t for i, t in enumerate(texts) if i % 3 == fold and set(t) & named[f]] for f, texts in _WORDS.items()}
        weights = _learned([*features([*_variants(rng, filler, seen), *_others(rng, filler, seen)]), *(d for i, d in enumerate(plain) if i % 5 != fold)], rng, 3)
        test = [*features([*_variants(rng, filler, left, 8), *_others(rng, filler, left)[::5]]), *plain[fold::5]]
        z.append(_logits(weights, test))
        y += [c for _, c in test]
    return np.concatenate(z), np.array(y)


def _without_notices(lines: list[str]) -> list[str]:
    """Lines that have enough of no template: what the corpus says beside notices, also of licences."""
    return [t for t in lines if all(likeness(w, f) < CONFIRM for f in TEMPLATES for w in [tokens(t)])]


def trained(negatives: list[str], seed: int = 7) -> Classifier:
    """Weights learned from all wordings, and the temperature that fits those left out."""
    temperature = _temperature(*held_out(negatives, seed))
    rng, known = np.random.default_rng(seed), Hashes()
    negatives = _without_notices(negatives)
    filler = [w for t in negatives for w in tokens(t)] or ["the"]
    data = [*_variants(rng, filler, _WORDS), *_others(rng, filler, _WORDS), *((tokens(t), 0) for t in negatives)]
    return Classifier(_learned([(np.concatenate(places(w, known)), y) for w, y in data if w], rng), temperature)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES) -> Classifier:
    """A classifier with one line each of about ``negatives`` documents, chosen by the hash of their id, as examples of all else."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    below = threshold(negatives, rows.count())
    lines = F.split(F.col(text_col).cast("string"), "\n")
    line = F.element_at(lines, (F.pmod(F.xxhash64(id_col, F.lit(1)), F.size(lines)) + 1).cast("int"))
    words = F.array_join(F.slice(F.split(line, " +"), 1, LONG), " ")  # what a unit has at most
    sample = rows.where(chosen(F.col(id_col), F.lit(below))).select(F.xxhash64(id_col).alias("place"), words.alias("line"))
    return trained([r.line for r in sample.orderBy("place", "line").limit(2 * negatives).collect()])


def licences(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_licences, families, spans, least_certain), a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def step(ids, texts):
        model = shared.value
        known = Hashes()
        for a, b in slices(len(ids), [len(t or "") for t in texts], 8 << 20):
            out = []
            for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                found = notices(model, text, known) if text else []
                names = sorted({f[2] for f in found})
                out.append((doc_id, len(found), ",".join(names), ",".join(f"{f[2]}:{f[0]}:{f[1]}" for f in found), min((f[3] for f in found), default=None)))
            yield dict(zip(("doc_id", "n_licences", "families", "spans", "least_certain"), map(list, zip(*out, strict=True)), strict=True))

    schema = "doc_id bigint, n_licences bigint, families string, spans string, least_certain double"
    return map_rows(docs, [F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")], step, schema)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences(docs, fitted(docs))
