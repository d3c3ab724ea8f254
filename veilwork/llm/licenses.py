"""Licence scans by a trained paragraph classifier.

A paragraph is a run of lines with a word; lines of white space or comment marks part paragraphs. Scanned are each line,
and each smallest run of wrapped lines that holds a template across line ends. The words and word pairs of such a unit are
sparse features of a multinomial logistic regression over licence families and the class ``unknown``. The probabilities
are calibrated by a temperature fitted on labelled units kept out of training, and a family counts only above a threshold
at which no kept-out unknown unit passes. A prediction is then confirmed by comparing the unit with the family's
templates: a template must occur in it up to a small share of its word pairs, over wrapped lines in one passage. A
paragraph has the families of all its units: "All rights reserved" above a BSD notice gives both. It is unconfirmed if it
has predictions, but none that is confirmed.

Labelled rows: units made by rule from licence names, notices and wrapped headers (the families), from other sentences
about rights and licences, and at most ``SAMPLE`` lines of the documents without any word on rights (unknown). The bound is
a parameter; prediction runs over all paragraphs of all documents.

Null texts have no paragraphs. Repeated rows are scanned each by itself; repeated lines count as often as they occur. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import random
import textwrap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from veilwork.llm.common import bytes_of, cell

SAMPLE = 2_000
UNKNOWN = "unknown"
#: Share of a template's word pairs that a paragraph must hold.
CONFIRM = 0.8

#: Names and notices of licence families.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "mit": ["MIT License", "MIT licence", "MIT (Expat) license"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0-only", "GNU General Public License, version 2", "GPLv3 license", "GPLv2 license"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-2.1-or-later", "LGPLv3 license"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0-only", "AGPLv3 license"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal"],
    "isc": ["ISC License", "ISC licence"],
    "proprietary": ["All rights reserved"],
}
NOTICES = {
    "apache-2.0": ["you may not use this file except in compliance with the License", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "gpl": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "proprietary": ["No part of this publication may be reproduced without the prior written permission of the publisher"],
}
#: Openings of file headers, as they are wrapped.
HEADERS = {
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at", "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
CARRIERS = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.",
    "This project is distributed under the terms of the {}.", "Published under {}.", "License: {}", "SPDX-License-Identifier: {}", "Available under the {}", "Copyright (c) 2020 The Authors. {}.",
    "The text is available under the {}; additional terms may apply.", "{}", "Code and data are covered by the {}.",
]
OTHERS = [
    "Licensed under the terms of our agreement.", "This work was released under pressure.", "The driver's license was issued in {}.", "Permission was granted by the city of {}.",
    "He studied at MIT in {}.", "The Apache people of {} lived here.", "General {} spoke to the public.", "A public license fee is due in {}.", "The copyright of {} is unclear.",
    "Creative work in common rooms of {}.", "All rights of {} were discussed.", "The software of {} has no warranty.", "Version 2.0 of {} was released.", "Version 3 of the {} plan.", "CC {} by mail.",
    "Published by {} under a new name.", "The license of {} was revoked.", "Use in {} is permitted by law.", "GNU herds near {}.", "Released under the sky of {}.",
]
_CUES = r"(?i)licen[cs]|copyright|permission|warrant|rights|redistribut|creative commons|\bGNU\b|\bMIT\b|\bBSD\b"
_MARKS = {b"dnl", b"rem"}
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in b".+-" else 32 for b in range(256))


def words_of(line: bytes) -> list[bytes]:
    """Lower-cased words; dots inside stay, as in version numbers."""
    return [w.strip(b".-+") for w in line.translate(_TO_WORDS).split()]


def paragraphs_of(text: bytes) -> list[list[list[bytes]]]:
    """The words of each line of each paragraph. Most comment marks are no words; those that are get dropped here."""
    out, block = [], []
    for line in text.split(b"\n"):
        words = [w for w in words_of(line) if w]
        if words and words[0] in _MARKS:
            words = words[1:]
        if words:
            block.append(words)
        elif block:
            out.append(block)
            block = []
    return [*out, block] if block else out


def labelled_lines(seed: int, plain: list[str]) -> list[tuple[str, str]]:
    """(line, family): families and unknown lines made by rule, and the given plain lines."""
    r = random.Random(seed)
    filler = " ".join(plain).split() or ["text"]
    out = [(p, UNKNOWN) for p in plain]
    for family, names in NAMES.items():
        for name in [*names, *NOTICES.get(family, [])]:
            for carrier in CARRIERS if name in names else ["{}", "{}."]:
                line = carrier.format(name)
                out.append((line, family))
                out.append((line + " " + " ".join(r.choices(filler, k=r.randint(1, 12))), family))
                out.append((" ".join(r.choices(filler, k=r.randint(1, 12))) + " " + line.lower(), family))
    for family, headers in HEADERS.items():
        for header in headers:
            for width in (64, 70, 75, 80):
                lines = textwrap.wrap(header, width)
                out += [(" ".join(lines[:n]), family) for n in range(2, len(lines) + 1)]
    for _ in range(15):
        for other in OTHERS:
            out.append((other.format(" ".join(r.choices(filler, k=r.randint(1, 4)))), UNKNOWN))
    r.shuffle(out)
    return out


class Classifier:
    """Logistic regression over words and word pairs, with temperature, threshold and templates."""

    def __init__(self, rows: list[tuple[str, str]], rounds: int = 150, penalty: float = 1e-3):
        self.families = [*sorted(NAMES), UNKNOWN]
        kept_out, train = rows[::4], [x for i, x in enumerate(rows) if i % 4]
        features: dict = {}
        for line, family in train:
            if family != UNKNOWN:
                words = words_of(line.encode())
                for f in [*words, *zip(words, words[1:])]:
                    features[f] = features.get(f, 0) + 1
        names = sorted((f for f, n in features.items() if n > 3), key=str)
        self.single = {f: i for i, f in enumerate(names) if isinstance(f, bytes)}
        self.pair = {f: i for i, f in enumerate(names) if not isinstance(f, bytes)}
        self.templates = {
            family: [set(zip(w, w[1:])) or {(w[0],)} for w in (words_of(t.encode()) for t in [*NAMES[family], *NOTICES.get(family, [])])] for family in NAMES
        }
        self.named = [(family, len(t)) for family, several in self.templates.items() for t in several]
        self.holders: dict = {}  # word pairs to the numbers of the templates that hold them
        for k, t in enumerate(t for several in self.templates.values() for t in several):
            for pair in t:
                if len(pair) == 2:
                    self.holders.setdefault(pair, []).append(k)
        self.weights = np.zeros((len(names) + 1, len(self.families)))
        self.temperature, self.threshold = 1.0, 0.5
        x, y = self._table(train, len(names))
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for turn in range(1, rounds + 1):
            p = self._softmax(x @ self.weights)
            p[np.arange(len(y)), y] -= 1
            g = x.T @ p / len(y) + penalty * self.weights / 10
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.weights -= 0.2 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        x, y = self._table(kept_out, len(names))
        scores = x @ self.weights
        loss = lambda t: -np.log(np.maximum(self._softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        p = self._softmax(scores / self.temperature)
        wrong = p[y == len(self.families) - 1, :-1]
        self.threshold = float(min(0.9, max(0.5, wrong.max() if wrong.size else 0.5)))
        best = p.argmax(axis=1)
        self.accuracy = float((best == y).mean())

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def _table(self, rows: list[tuple[str, str]], n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), n + 1), np.float32)
        for i, (line, _) in enumerate(rows):
            x[i, self.ids(words_of(line.encode()))] = 1
        x[:, n] = 1
        return x, np.array([self.families.index(f) for _, f in rows])

    def ids(self, words: list[bytes]) -> list[int]:
        get, both = self.single.get, self.pair.get
        found = set()
        before = None
        for w in words:
            i = get(w)
            if i is not None:
                found.add(i)
                if before is not None and (k := both((before, w))) is not None:
                    found.add(k)
                before = w
            else:
                before = None
        return list(found)

    def scan(self, line: bytes) -> tuple[str, float, bool]:
        """(family, probability, confirmed) of one line."""
        return self.judge(words_of(line))

    def judge(self, words: list[bytes]) -> tuple[str, float, bool]:
        """(family, probability, confirmed) of the words of one unit."""
        ids = self.ids(words)
        if not ids:
            return UNKNOWN, 0.0, False
        p = self._softmax((self.weights[ids].sum(axis=0) + self.weights[-1])[None, :] / self.temperature)[0]
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] <= self.threshold:
            return UNKNOWN, float(p[k]), False
        pairs = {*zip(words, words[1:]), *((w,) for w in words)}
        like = max(len(t & pairs) / len(t) for t in self.templates[family])
        return family, float(p[k]), like >= CONFIRM

    def runs(self, block: list[list[bytes]]) -> list[tuple[str, int, int]]:
        """(family, first line, last line) of the smallest runs of several lines that hold a template in one passage."""
        get, hits = self.holders.get, {}
        at, before = 0, None
        for i, words in enumerate(block):
            for j, w in enumerate(words):
                for k in get((before, w), ()):
                    hits.setdefault(k, []).append((at, i, i if j else i - 1, (before, w)))
                before, at = w, at + 1
        found = set()
        for k, places in hits.items():
            family, size = self.named[k]
            need, inside, left = math.ceil(CONFIRM * size), {}, 0
            if len(places) < need:
                continue
            for at, last, _, pair in places:
                inside[pair] = inside.get(pair, 0) + 1
                while inside[places[left][3]] > 1 or at - places[left][0] >= 2 * size:
                    inside[places[left][3]] -= 1
                    if not inside[places[left][3]]:
                        del inside[places[left][3]]
                    left += 1
                if len(inside) >= need and places[left][2] < last:
                    found.add((family, places[left][2], last))
        return sorted(found)

    def paragraph(self, block: list[list[bytes]]) -> list[tuple[str, float, bool]]:
        """The predictions of a paragraph's lines, and the confirmed ones of its runs of wrapped lines."""
        hits = [h for h in map(self.judge, block) if h[0] != UNKNOWN]
        if len(block) > 1:
            for family, first, last in self.runs(block):
                h = self.judge([w for words in block[first : last + 1] for w in words])
                if h[0] == family and h[2]:
                    hits.append(h)
        return hits


def plain_lines(docs: DataFrame, text_col: str, sample: int) -> list[str]:
    """A bounded sample of lines without a word on rights: those with the smallest hashes.

    Only lines in the lowest share of hashes are sorted, so that about as many as there are sampled documents are moved.
    """
    share = min(1.0, 2 * sample / max(1, docs.count()))
    lines = docs.select(F.explode(F.split(cell(text_col), "\n")).alias("line")).where(F.pmod(F.xxhash64("line"), F.lit(1 << 20)) < share * (1 << 20))
    plain = lines.where((F.length("line") > 0) & (F.length("line") < 2000) & ~F.col("line").rlike(_CUES))
    return [r["line"] for r in plain.distinct().orderBy(F.xxhash64("line"), "line").limit(sample).collect()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: paragraphs, those with a confirmed licence, the families (sorted, comma-joined), the best probability.

    ``n_unconfirmed`` counts the paragraphs with predictions, none of them confirmed.
    """
    model = Classifier(labelled_lines(11, plain_lines(docs, text_col, sample)))

    kind = StructType(
        [StructField("n_paragraphs", LongType()), StructField("n_licensed", LongType()), StructField("n_unconfirmed", LongType()), StructField("families", ArrayType(StringType())), StructField("probability", DoubleType())]
    )

    @F.arrow_udf(kind)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for text in bytes_of(texts):
            blocks = [model.paragraph(block) for block in paragraphs_of(text or b"")]
            sure = [h for hits in blocks for h in hits if h[2]]
            n_sure = sum(any(h[2] for h in hits) for hits in blocks)
            rows.append((len(blocks), n_sure, sum(map(bool, blocks)) - n_sure, sorted({h[0] for h in sure}), round(max((h[1] for h in sure), default=0.0), 6)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=kind.names)

    found = docs.select(cell(id_col).alias("doc_id"), scan(cell(text_col)).alias("s"))
    return found.select("doc_id", "s.n_paragraphs", "s.n_licensed", "s.n_unconfirmed", F.array_join("s.families", ",").alias("families"), "s.probability")
