"""License scans by patience alignment.

A text and a license template are compared word by word: words that occur once in both are anchors, the longest
increasing subsequence of their places fixes the alignment, and the gaps between are aligned the same way. A gap without
such words takes its common head and tail and then a longest common subsequence. Coverage is the share of the
template's words that are matched.

Every whole text is searched. A match of coverage ``COVERAGE`` leaves at most a known number of template words
unmatched, so of one word more than that at least one is matched: a template is aligned around every place where
one of that many of its longest words stands, within ``REACH`` template lengths. Nothing that could reach the coverage
is passed over.

Null and empty texts match nothing. Repeated rows give repeated results; doc_id may be null. Of several equally good
places in a text the first is reported.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
REACH = 1.5
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Notices and license passages as their publishers word them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(lower-case word, start, end) of a text."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def increasing(seconds: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(seconds)
    for k, v in enumerate(seconds):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = v, k
        back[k] = top_at[pile - 1] if pile else -1
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two short lists."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of two word lists, by patience alignment."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, e, j, f = gaps.pop()
        while i < e and j < f and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < e and j < f and a[e - 1] == b[f - 1]:
            e, f = e - 1, f - 1
            out.append((e, f))
        if i >= e or j >= f:
            continue
        na, nb = Counter(a[i:e]), Counter(b[j:f])
        place = {w: j + k for k, w in enumerate(b[j:f]) if nb[w] == 1}
        anchors = [(i + k, place[w]) for k, w in enumerate(a[i:e]) if na[w] == 1 and w in place]
        if not anchors:
            if na.keys() & nb.keys():
                shared_a = [k for k in range(i, e) if a[k] in nb]
                shared_b = [k for k in range(j, f) if b[k] in na]
                out += [(shared_a[x], shared_b[y]) for x, y in common_subsequence([a[k] for k in shared_a], [b[k] for k in shared_b])]
            continue
        chain = [anchors[k] for k in increasing([q for _, q in anchors])]
        out += chain
        edges = [(i - 1, j - 1), *chain, (e, f)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = []
        self.seeds: dict[str, list[int]] = {}
        for name, text in templates.items():
            words = [w for w, _, _ in words_of(text)]
            spare = math.floor((1 - coverage) * len(words) + 1e-9)
            places = sorted(range(len(words)), key=lambda k: (-len(words[k]), k))[:spare + 1]
            for w in {words[k] for k in places}:
                self.seeds.setdefault(w, []).append(len(self.templates))
            self.templates.append((name, words, Counter(words)))

    def scan(self, text: str) -> list[tuple]:
        """(template, coverage, matched words, template words, start, end) of each template found; characters of the text."""
        found = words_of(text)
        words = [w for w, _, _ in found]
        hits: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for t in self.seeds.get(w, ()):
                hits.setdefault(t, []).append(i)
        out = []
        for t in sorted(hits):
            name, template, counts = self.templates[t]
            m = len(template)
            least, reach = math.ceil(self.coverage * m - 1e-9), math.ceil(REACH * m)
            best, passed = None, -1
            for at in hits[t]:
                if at <= passed:                       # inside a complete match
                    continue
                lo = max(0, at - reach)
                region = words[lo:at + reach + 1]
                if (counts & Counter(region)).total() < least:
                    continue
                pairs = align(region, template)
                if len(pairs) >= least and (best is None or len(pairs) > best[0]):
                    best = len(pairs), lo + pairs[0][0], lo + pairs[-1][0]
                if len(pairs) == m:
                    passed = lo + pairs[-1][0]
            if best:
                out.append((name, best[0] / m, best[0], m, found[best[1]][1], found[best[2]][2]))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per text and template found: doc_id, license, coverage, matched, template_words, start, end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for r in scanner.scan(text) if text else ():
                    at.append(i)
                    rows.append(r)
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["doc_id", "license", "coverage", "matched", "template_words", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, coverage double, matched bigint, template_words bigint, start bigint, end bigint")
