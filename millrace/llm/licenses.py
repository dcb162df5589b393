"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised to lower-case words of letters and digits.
A passage's likeness to a template is the Dice coefficient of their multisets
of word bigrams, ``2 |A and B| / (|A| + |B|)``.

Where a passage may begin and end isn't known.  The best one begins and ends at
a bigram that the text shares with the template, as any other gains by leaving
its ends out.  Dice ``t`` against a template of ``m`` bigrams bounds a passage
to ``t / (2 - t) * m`` shared bigrams at least and ``(2 - t) / t * m`` bigrams
at most, so only shared bigrams that enough others follow within that length
can begin one; from each of them every end is tried, the overlap being kept up
to date.  No passage that reaches the threshold is left out.

Scale: one pass without a shuffle: one table lookup per bigram, and work in
proportion to the shared bigrams times the template's length.

Defined cases: a null text counts as empty and has no licence; equal scores go
to the template listed first; repeated rows are scanned alike; a very long text is
scanned as a whole; an empty table
gives an empty result; further columns of the input, whatever their names, are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.8

#: Licence notices as their publishers word them.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

_WORDS = re.compile(r"[^\W_]+").findall


def normalised(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def dice(a: list[str], b: list[str]) -> float:
    """Of two word lists, over their multisets of bigrams."""
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * (x & y).total() / max(1, x.total() + y.total())


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.least, self.most = threshold / (2 - threshold), (2 - threshold) / threshold
        self.texts = [(name, normalised(t)) for name, notices in templates.items() for t in notices]
        self.bags = [Counter(zip(words, words[1:], strict=False)) for _, words in self.texts]
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, bag in enumerate(self.bags):
            for pair in bag:
                self.index[pair].append(k)
        self.index = dict(self.index)

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        """(licence, likeness) of the licences found, the likest first."""
        words = normalised(text)
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = defaultdict(list)
        known = self.index
        for at, pair in enumerate(zip(words, words[1:], strict=False)):
            if pair in known:
                for k in known[pair]:
                    hits[k].append((at, pair))
        best: dict[str, float] = {}
        for k, found in hits.items():
            name, template = self.texts[k]
            m = len(template) - 1
            if len(found) < self.least * m - 1e-9:
                continue
            score = self._best(self.bags[k], m, found)
            if score >= self.threshold:
                best[name] = max(best.get(name, 0.0), score)
        order = {name: i for i, (name, _) in enumerate(self.texts)}
        return sorted(best.items(), key=lambda x: (-x[1], order[x[0]]))

    def _best(self, bag: Counter[tuple[str, str]], m: int, found: list[tuple[int, tuple[str, str]]]) -> float:
        """The best likeness of a passage between two of the shared bigrams (place, bigram), in order; below the threshold any value."""
        best, end = 0.0, 0
        for i, (start, _) in enumerate(found):
            while end < len(found) and found[end][0] - start + 1 <= self.most * m + 1e-9:
                end += 1
            # Dice >= t needs so many shared bigrams
            if end - i < self.least * m - 1e-9:
                continue
            left, shared = dict(bag), 0
            for at, pair in found[i:end]:
                if left[pair]:
                    left[pair] -= 1
                    shared += 1
                    best = max(best, 2 * shared / (at - start + 1 + m))
            if best == 1.0:
                break
        return best


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, tuple[str, ...]], ...], threshold: float) -> Scanner:
    return Scanner(dict(templates), threshold)


def licences(text: Column, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Column:
    """Array of (licence, dice) found in a text, the likest first; ``templates`` has the notices or full texts of each licence."""
    given = tuple((name, tuple(texts)) for name, texts in templates.items())
    kind = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())]))
    shape = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64())]))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        s = _scanner(given, threshold)
        return pa.array([[{"licence": n, "dice": d} for n, d in s.scan(t.as_py())] for t in texts], shape)

    return run(text)
