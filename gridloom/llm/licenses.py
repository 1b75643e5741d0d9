"""Licence scans: a trained classifier of paragraphs, confirmed against templates.

Every paragraph (a line with a word) is looked at in overlapping windows of 2 * STEP words, one
every STEP, so that a notice is found wherever it stands in a line and however long that is.
A window is a bag of hashed unigrams and bigrams of its words (runs of letters and digits,
ASCII letters in lower case).  Multinomial logistic regression gives it a distribution over the licence families of TEMPLATES, "unknown" and
"none".  It is trained on the driver, by Adagrad over sparse rows, from the templates as they
are and as seeded edits leave them (words dropped, sentences cut out, background words
around), from sentences about UNLISTED licences as "unknown", and from up to WINDOWS windows
of each of BACKGROUND paragraphs of the corpus as "none".  A temperature is fitted on edits
that weren't trained on and on the licences of UNLISTED_HELD, so that probabilities can be
held against CERTAIN.  A prediction counts only if a template of that family confirms it: at
least CONFIRMED of the bigrams of the template, or of the window, are in the other, among
them one that no other licence has.  What isn't confirmed is unknown if it's a licence with a
probability that at most FALSE_ALARMS of held-out windows without one reach, and nothing of
PROSE_HELD, and has COMMON bigrams that several licences share and PROSE doesn't have.

Defined results: a null or empty text has no paragraphs and no licence; a document's
licence is the family of its confirmed window with the highest probability, ties to the
family that is first in TEMPLATES; without one it is "unknown" if a window is, which n_licensed
doesn't count; rows are scanned as often as they occur, texts whole; other
columns are not looked at; an empty table gives an empty one (the classifier is then trained
on the templates alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal

CELLS = 1 << 16
BACKGROUND, WINDOWS, EDITS, HELD, UNLISTED_EDITS, EPOCHS = 4000, 3, 60, 20, 5, 15
#: Words from one window to the next; a window has twice as many.
STEP = 6
CERTAIN, CONFIRMED = 0.6, 0.6
NONE, UNKNOWN = "none", "unknown"
#: Share of held-out windows without a licence that may be called unknown, and bigrams common to licences that such a window has.
FALSE_ALARMS, COMMON = 1e-3, 1

#: Notices by which licences are named, and the sentences that open or mark their texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ),
}
#: Paragraphs that only sound like a licence.
NEAR_MISSES = (
    "The driver was asked for a license and papers.",
    "A license to hunt must be renewed every year with the county.",
    "All rights reserved.",
    "The permission of the owner is needed to copy the work.",
    "The software is free of charge for members of the public.",
    "The general public was admitted under the terms of the new version.",
)

#: Prose in words that licences use, trained on as NONE ...
PROSE = (
    "Under the terms of the treaty the river is open to the ships of both countries.",
    "The contract is subject to the approval of the council and to the law of the land.",
    "He was the first person to be granted a license by the city.",
    "The conditions of the sale were made public the next day.",
    "You may not enter the garden without the permission of the owner.",
    "Her version of the story is different from the one in the file.",
    "The source of the river is marked by a stone, and the code of the tribe forbids its use.",
    "The general told the public that the work of the foundation would go on.",
    "Driving without a license is punished under the law.",
    "The new version of the program is sold with a license for five computers.",
    "The company paid for a license to use the patent, for any purpose it liked.",
    "The terms of the license were discussed by the members of the board.",
    "They use and copy the old forms, with or without changes.",
    "Copies of the book may be obtained at the library free of charge.",
    "This work is the first of its kind and was published in 1905.",
    "The software is distributed on disks and runs in all versions of the system.",
)
#: ... and held out, to fit the bound of UNKNOWN.
PROSE_HELD = (
    "All the rights of the owner are subject to the terms of the will.",
    "The pilot lost his license in the spring, and the ship was sold.",
    "The public is free to use the park under the conditions of the charter.",
    "A fishing license is granted to any person who pays the fee.",
    "The library may copy and distribute the works of the author.",
    "The software of the machine was written by members of the public.",
    "Version two of the plan is open to anyone and free of any restriction.",
    "No person may modify this file without the permission of the general.",
)
#: Licences that aren't listed, by name and identifier.  Trained on as UNKNOWN ...
UNLISTED = (
    ("Artistic License", "Artistic-2.0"), ("Common Development and Distribution License", "CDDL-1.0"), ("European Union Public Licence", "EUPL-1.2"),
    ("Microsoft Public License", "MS-PL"), ("Boost Software License", "BSL-1.0"), ("Academic Free License", "AFL-3.0"), ("Open Software License", "OSL-3.0"),
    ("GNU Free Documentation License", "GFDL-1.3-only"), ("Q Public License", "QPL-1.0"), ("IBM Public License", "IPL-1.0"), ("CeCILL license", "CECILL-2.1"),
    ("wxWindows Library Licence", "wxWindows"), ("Educational Community License", "ECL-2.0"), ("Sun Public License", "SPL-1.0"), ("Ruby License", "Ruby"),
    ("PHP License", "PHP-3.01"), ("Business Source License", "BUSL-1.1"), ("CC BY-ND 4.0", "CC-BY-ND-4.0"), ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-3.0"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-3.0"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-3.0"),
)
#: ... and held out, to fit the temperature and the bound of UNKNOWN.
UNLISTED_HELD = (
    ("zlib License", "Zlib"), ("Python Software Foundation License", "PSF-2.0"), ("PostgreSQL License", "PostgreSQL"), ("SIL Open Font License", "OFL-1.1"),
    ("Common Public License", "CPL-1.0"), ("Lucent Public License", "LPL-1.02"), ("NASA Open Source Agreement", "NASA-1.3"), ("Server Side Public License", "SSPL-1.0"),
)
#: The sentences of TEMPLATES, and others, with another licence's name or identifier in them.
CARRIERS = (
    "Released under the {name}.",
    "Licensed under the {name}, Version 2.0.",
    "Licensed under the {name}.",
    "Licensed under {name}.",
    "Licensed under the {name}, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at http://www.{id}.org/licenses/LICENSE-2.0",
    "This work is licensed under the {name}, version 3.",
    "This work is licensed under a {name}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the",
    "This library is free software; you can redistribute it and/or modify it under the terms of the {name}",
    "This library is licensed under the {name}, version 2.1.",
    "This Source Code Form is subject to the terms of the {name}, v. 2.0.",
    "This file is distributed under the terms of the {name}, version 1.0.",
    "SPDX-License-Identifier: {id}",
    "SPDX-License-Identifier: {bare}",
)
#: Sentences of unlisted licences that are close to a template.
UNLISTED_TEXTS = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
)

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[[b for b in range(128) if chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(block: V.Block) -> tuple[V.Spans, np.ndarray, np.ndarray]:
    """The block's lines, and for each word its hash and its line."""
    lines = block.lines()
    inside = _WORD[block.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[block.offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    if len(start):
        keep = inside[start]
        start, end = start[keep], end[keep]
    return lines, V.span_hashes(_LOWER[block.data], start, end), np.searchsorted(lines.end, start, side="right")


def _bigrams(h: np.ndarray) -> np.ndarray:
    return V.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def grams(block: V.Block) -> tuple[V.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """The block's lines, and for each gram of a line its hash, the line, and whether it's a bigram; line by line."""
    lines, h, line = _words(block)
    next_ = line[1:] == line[:-1]
    two = _bigrams(h)[next_]
    at = np.concatenate([line, line[1:][next_]])
    order = np.argsort(at, kind="stable")
    pair = np.concatenate([np.zeros(len(h), bool), np.ones(len(two), bool)])
    return lines, np.concatenate([h, two])[order], at[order], pair[order]


def _chunks(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, given by their lines, in runs of STEP: where each run starts and ends, whether the line goes on behind it, and which runs open a window.

    A window is a run and the one behind it; every run but the last of its line opens one, and so does one that is all its line.
    """
    opens = np.flatnonzero(np.diff(line, prepend=-1))
    place = np.arange(len(line)) - np.repeat(opens, np.diff(np.append(opens, len(line))))
    start = np.flatnonzero(place % STEP == 0)
    end = np.append(start[1:], len(line))
    on = np.append(line[start[1:]] == line[start[:-1]], False)
    return start, end, on, np.flatnonzero(on | (place[start] == 0))


def _bags(paragraphs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct gram hashes of each paragraph, and of its bigrams alone."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for block in V.blocks(pa.array([p.replace("\n", " ") for p in paragraphs], pa.string())):
        _, h, line, pair = grams(block)
        cut = np.searchsorted(line, np.arange(block.rows + 1))
        out += [(np.unique(h[a:b]), np.unique(h[a:b][pair[a:b]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


@dataclass
class Classifier:
    """families (the last two are UNKNOWN and NONE), weights (cells x families), bias, temperature, each family's templates as sets of bigrams.

    marks: the bigrams of each family that no other licence has, listed or trained on as UNKNOWN; common: those of several licences and no prose;
    bound: the probability of any licence from which a window without a confirmed family is unknown.
    """

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[list[np.ndarray]]
    marks: list[np.ndarray]
    common: np.ndarray
    bound: float

    def confirms(self, family: int, own: np.ndarray) -> bool:
        """Whether a template of the family is in a window of these bigrams, or the window in it, with a mark of that template."""
        for template in self.templates[family]:
            shared = template[np.isin(template, own)]
            if len(shared) >= CONFIRMED * min(len(template), len(own)) and np.isin(shared, self.marks[family]).any():
                return True
        return False

    def scores(self, block: V.Block) -> tuple[V.Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's lines; of each window its probabilities, its line, and where its words start and end; the bigram behind each word."""
        lines, h, line = _words(block)
        if not len(h):
            none = np.zeros(0, np.int64)
            return lines, np.zeros((0, len(self.families))), none, none, none, h
        start, end, on, first = _chunks(line)
        two = np.append(_bigrams(h), np.uint64(0))
        cell = lambda x: (x % CELLS).astype(np.int64)
        own = self.weights[cell(h)]
        inner = np.ones(len(h), bool)
        inner[end - 1] = False  # the bigram behind a run's last word isn't all in the run
        own[inner] += self.weights[cell(two[inner])]
        run = np.add.reduceat(own, start, axis=0)
        z, both = run[first], on[first]
        z[both] += run[first[both] + 1] + self.weights[cell(two[end[first[both]] - 1])]
        last = np.where(both, end[np.minimum(first + 1, len(end) - 1)], end[first])
        n = 2 * (last - start[first]) - 1
        return lines, _softmax((z / np.sqrt(n)[:, None] + self.bias) / self.temperature), line[start[first]], start[first], last, two


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _edited(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    """text with some words dropped, maybe cut short, maybe with other words around it, as a window would hold it."""
    words = text.split()
    if len(words) > 12:
        a = int(rng.integers(0, len(words) - 10))
        words = words[a : a + int(rng.integers(10, len(words) + 1))]
    words = [w for w in words if rng.random() > 0.06] or words
    if filler and rng.random() < 0.6:
        before, behind = (int(k) for k in rng.integers(0, STEP + 2, 2))
        own = [filler[int(i)] for i in rng.integers(0, len(filler), before + behind)]
        room = max(0, 2 * STEP - len(words))
        before = min(before, room)
        words = own[:before] + words + own[before:][: min(behind, room - before)]
    return " ".join(words)


def _cut(paragraphs: list[str], rng: np.random.Generator) -> list[str]:
    """WINDOWS windows of each paragraph, or what it has."""
    out = []
    for p in paragraphs:
        words = p.split()
        starts = range(0, max(1, len(words) - STEP), STEP)
        out += [" ".join(words[a : a + 2 * STEP]) for a in (starts[int(k)] for k in np.sort(rng.permutation(len(starts))[:WINDOWS]))]
    return sorted(set(out))


def _carried(names: tuple[tuple[str, str], ...]) -> list[list[str]]:
    """For each licence the sentences of CARRIERS about it."""
    return [[c.format(name=name, id=id_, bare=id_.split("-")[0]) for c in CARRIERS] for name, id_ in names]


def train(background: list[str], seed: int = 11) -> Classifier:
    """A classifier from the templates and paragraphs of the corpus.  The same paragraphs, in any order, give the same one."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN, NONE]
    bags = _bags([t for own in TEMPLATES.values() for t in own])
    templates, at = [], 0
    for own in TEMPLATES.values():
        templates.append([b for _, b in bags[at : at + len(own)]])
        at += len(own)
    unlisted, unlisted_held = (_carried(names) for names in (UNLISTED, UNLISTED_HELD))
    unlisted.append(list(UNLISTED_TEXTS))
    each = [np.unique(np.concatenate(own)) for own in templates] + [np.unique(np.concatenate([b for _, b in _bags(own)])) for own in unlisted]
    known, licences = np.unique(np.concatenate(each), return_counts=True)
    common = known[licences > 1]
    marks = [np.setdiff1d(own, common) for own in each[: len(TEMPLATES)]]
    background = sorted(set(background))
    filler = [w for p in background[:200] for w in p.split()[:20]]
    cut = _cut(background, rng)
    plain = [p for p, (_, b) in zip(cut, _bags(cut), strict=True) if np.isin(b, known).sum() < max(2, 0.2 * len(b))]
    texts, labels = [], []
    for k, own in enumerate(TEMPLATES.values()):
        for t in own:
            texts += [t, *(_edited(t, rng, filler) for _ in range(EDITS + HELD))]
            labels += [k] * (1 + EDITS + HELD)
    held = np.arange(len(texts)) % (1 + EDITS + HELD) > EDITS
    for out, names in ((False, unlisted), (True, unlisted_held)):
        own = [x for each_ in names for t in each_ for x in (t, *(_edited(t, rng, filler) for _ in range(UNLISTED_EDITS)))]
        texts += own
        labels += [len(families) - 2] * len(own)
        held = np.concatenate([held, np.full(len(own), out)])
    prose = [*NEAR_MISSES, *PROSE]
    none = [*plain, *prose, *(_edited(t, rng, filler) for t in prose for _ in range(EDITS))]
    aside = [x for t in PROSE_HELD for x in (t, *(_edited(t, rng, filler) for _ in range(UNLISTED_EDITS)))]
    common = np.setdiff1d(common, np.concatenate([b for _, b in _bags(prose)]))
    texts += none + aside
    labels += [len(families) - 1] * (len(none) + len(aside))
    held = np.concatenate([held, np.arange(len(none)) % 5 == 4, np.ones(len(aside), bool)])
    rows = [np.unique((h % CELLS).astype(np.int64)) for h, _ in _bags(texts)]
    y = np.array(labels)
    w, b = np.zeros((CELLS, len(families)), np.float32), np.zeros(len(families), np.float32)
    gw, gb = np.full((CELLS, 1), 1e-2, np.float32), np.full(len(families), 1e-2, np.float32)
    share = len(y) / (len(families) * np.bincount(y, minlength=len(families)))
    fit = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for group in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            cells = np.concatenate([rows[k] for k in group])
            n = np.array([len(rows[k]) for k in group])
            who = np.repeat(np.arange(len(group)), n)
            x = (1 / np.sqrt(np.maximum(n, 1)))[who]
            z = np.zeros((len(group), len(families)))
            np.add.at(z, who, w[cells] * x[:, None])
            g = _softmax(z + b)
            g[np.arange(len(group)), y[group]] -= 1
            g *= np.sqrt(np.minimum(share[y[group]], 10))[:, None] / len(group)
            some, back = np.unique(cells, return_inverse=True)
            d = np.zeros((len(some), len(families)), np.float32)
            np.add.at(d, back, g[who] * x[:, None])
            d += 1e-6 * w[some]
            gw[some] += (d * d).sum(axis=1, keepdims=True)
            w[some] -= 0.3 * d / np.sqrt(gw[some])
            gb += g.sum(axis=0) ** 2
            b -= 0.3 * g.sum(axis=0) / np.sqrt(gb)
    test = np.flatnonzero(held)
    z = np.array([w[rows[k]].sum(axis=0) / np.sqrt(max(1, len(rows[k]))) + b for k in test])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 4, 33), key=loss))
    any_ = 1 - _softmax(z / temperature)[:, -1]
    bound = max(0.5, float(np.quantile(any_[y[test] == len(families) - 1], 1 - FALSE_ALARMS)), float(any_[-len(aside) :].max()))
    return Classifier(families, w, b, temperature, templates, marks, common, bound)


def scan_block(model: Classifier, block: V.Block) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """Of each text: paragraphs, those with a confirmed licence, its licence (or UNKNOWN) and the probability."""
    lines, p, line, start, end, two = model.scores(block)
    total = np.bincount(lines.doc[np.unique(line)], minlength=block.rows)
    listed = len(model.families) - 2
    family, best, any_ = p[:, :listed].argmax(axis=1), p[:, :listed].max(axis=1, initial=0), 1 - p[:, -1]
    count, names, score = np.zeros(block.rows, np.int64), [None] * block.rows, np.zeros(block.rows)
    counted = -1
    for k in np.flatnonzero((best >= CERTAIN) | (any_ >= model.bound)).tolist():
        own, d = np.unique(two[start[k] : end[k] - 1]), lines.doc[line[k]]
        if best[k] >= CERTAIN and model.confirms(family[k], own):
            count[d] += line[k] != counted
            counted = line[k]
            better = best[k] > score[d] or (best[k] == score[d] and family[k] < model.families.index(names[d]))
            if names[d] in (None, UNKNOWN) or better:
                score[d], names[d] = best[k], model.families[family[k]]
        elif names[d] in (None, UNKNOWN) and any_[k] >= max(model.bound, score[d]) and np.isin(own, model.common).sum() >= COMMON:
            score[d], names[d] = any_[k], UNKNOWN
    return total, count, names, score


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier with about BACKGROUND paragraphs of the corpus, one a drawn document, as "none"."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(1 << 30)) < min(1.0, BACKGROUND / max(1, n)) * (1 << 30))
    lines = F.split("text", "\n")
    one = F.substring(F.get(lines, F.pmod(F.xxhash64(F.lit(6), "text"), F.size(lines)).cast("int")), 1, 2000)
    return train([r[0] for r in drawn.select(one.alias("line")).distinct().collect() if r[0]])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_paragraphs, n_licensed, license (UNKNOWN if it's of no listed family, null if none) and confidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x families weights

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                total, count, names, score = scan_block(shared.value, block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(total, pa.int64()), pa.array(count), pa.array(names, pa.string()), pa.array(score)], names=["id", "n_paragraphs", "n_licensed", "license", "confidence"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_paragraphs bigint, n_licensed bigint, license string, confidence double").withColumnRenamed("id", id_col)
