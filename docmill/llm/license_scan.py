"""License scans by patience alignment of texts with license templates.

A template's words are aligned with a stretch of the text: words unique to both sides are anchors,
the longest increasing subsequence of anchors is kept, and the gaps between anchors are aligned in
the same way; a gap without anchors keeps its equal ends, then falls back to a longest common
subsequence (gaps are at most as long as a stretch). Coverage is the share of the template's words
that found their place; matched words must lie within `slack` template lengths.

Where to align follows from the wanted coverage: a stretch that covers a share c of an n-word
template holds at least one of any n - ceil(c n) + 1 of its words, so those, longest first, are the
only places looked at. This loses nothing and leaves texts without such a word after one pass.
A place is aligned only if the words around it, as a multiset, share enough with the template; that
count slides along the text, so a text of hot words costs one step a word. Whole texts are scanned, in a
narrow map without a shuffle. Templates travel with the code in groups of `TEMPLATE_WORDS` words, a pass
over the texts for each group.

Edge cases: null and wordless texts have no match; templates without words never match; repeated
rows get equal results; overlapping matches of different templates are all reported; of one
template the matches do not overlap, found from left to right; result columns replace input columns of
the same name.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import append_columns, fresh_name, member, word_slices

TEMPLATE_WORDS = 200_000

# Widely used notices, as their licenses word them.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles with back links)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Longest common subsequence as index pairs; earliest places in `b` among equals."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    bb = np.array(b)
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(bb == a[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b) and best[i, j]:
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] == best[i, j]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched (index in a, index in b), increasing in both."""
    out: list[tuple[int, int]] = []
    jobs = [(0, len(a), 0, len(b))]
    while jobs:
        i, ie, j, je = jobs.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        ca, cb = Counter(a[i:ie]), Counter(b[j:je])
        place = {v: k for k, v in enumerate(b[j:je], j) if cb[v] == 1}
        anchors = [(k, place[a[k]]) for k in range(i, ie) if ca[a[k]] == 1 and a[k] in place]
        anchors = [anchors[k] for k in increasing([p for _, p in anchors])]
        if not anchors:
            out.extend((i + x, j + y) for x, y in common_subsequence(a[i:ie], b[j:je]))
            continue
        for (x, y), (xe, ye) in zip([(i - 1, j - 1), *anchors], [*anchors, (ie, je)], strict=True):
            jobs.append((x + 1, xe, y + 1, ye))
        out.extend(anchors)
    return sorted(out)


def densest(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The most pairs whose places in the text lie within `reach` words; the leftmost of equals."""
    best, lo = (0, 0), 0
    for hi in range(len(pairs)):
        while pairs[hi][1] - pairs[lo][1] >= reach:
            lo += 1
        if hi + 1 - lo > best[1] - best[0]:
            best = (lo, hi + 1)
    return pairs[best[0] : best[1]]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, slack: float) -> None:
        self.names = sorted(templates)
        self.coverage = coverage
        self.words: list[list[int]] = []
        seeds: dict[int, set[int]] = defaultdict(set)
        for k, name in enumerate(self.names):
            _, _, _, _, w = next(word_slices(pa.array([templates[name]])), (0, 0, None, None, None)) if templates[name] else (0, 0, None, None, None)
            own = w.hash.tolist() if w is not None else []
            self.words.append(own)
            if own:
                most = len(own) - math.ceil(coverage * len(own) - 1e-9) + 1
                for i in sorted(range(len(own)), key=lambda i: (-(w.end[i] - w.start[i]), i))[:most]:
                    seeds[own[i]].add(k)
        self.counts = [Counter(x) for x in self.words]
        self.sets = [np.array(sorted(c), np.uint64) for c in self.counts]
        self.reach = [math.ceil(slack * len(x)) + 2 for x in self.words]
        self.keys = np.array(sorted(seeds), np.uint64)
        self.owners = [sorted(seeds[k]) for k in sorted(seeds)]

    def scan(self, hashes: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, word after the last) of every match."""
        return self.from_seeds(hashes, np.flatnonzero(member(hashes, self.keys) >= 0))

    def from_seeds(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[str, float, int, int]]:
        by: dict[int, list[int]] = defaultdict(list)
        for p, k in zip(at.tolist(), member(hashes[at], self.keys).tolist(), strict=True):
            for t in self.owners[k]:
                by[t].append(p)
        out = []
        for t, places in sorted(by.items()):
            own, reach, done = self.words[t], self.reach[t], 0
            need = math.ceil(self.coverage * len(own) - 1e-9)
            shared = self.shared(hashes, t, places)
            for p, most in zip(places, shared, strict=True):
                if p < done or most < need:
                    continue
                lo, hi = max(done, p - reach), min(len(hashes), p + reach)
                pairs = densest([(i, lo + j) for i, j in align(own, hashes[lo:hi].tolist())], reach)
                if len(pairs) >= need:
                    out.append((self.names[t], len(pairs) / len(own), pairs[0][1], pairs[-1][1] + 1))
                    done = pairs[-1][1] + 1
        return sorted(out, key=lambda m: (m[2], m[0]))

    def shared(self, hashes: np.ndarray, t: int, places: list[int]) -> list[int]:
        """Size of the multiset intersection of the template and the words within reach of each place, which no alignment exceeds."""
        at = np.flatnonzero(member(hashes, self.sets[t]) >= 0)
        word, at = hashes[at].tolist(), at.tolist()
        held: dict[int, int] = defaultdict(int)
        counts, reach, total, lo, hi, out = self.counts[t], self.reach[t], 0, 0, 0, []
        for p in places:
            while hi < len(at) and at[hi] < p + reach:
                held[word[hi]] += 1
                total += held[word[hi]] <= counts[word[hi]]
                hi += 1
            while lo < hi and at[lo] < p - reach:
                total -= held[word[lo]] <= counts[word[lo]]
                held[word[lo]] -= 1
                lo += 1
            out.append(total)
        return out


def grouped(templates: dict[str, str], most: int) -> list[dict[str, str]]:
    """Groups of templates with about `most` words at most, or one template."""
    out: list[dict[str, str]] = [{}]
    size = 0
    for name in sorted(templates):
        n = len((templates[name] or "").split())
        if out[-1] and size + n > most:
            out.append({})
            size = 0
        out[-1][name] = templates[name]
        size += n
    return out


MATCHES = T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, text_col: str = "text", coverage: float = 0.8, slack: float = 1.5) -> DataFrame:
    """`docs` with license_words (words of the text) and license_matches (template, coverage, from_word, to_word)."""
    first, *rest = grouped(TEMPLATES if templates is None else templates, TEMPLATE_WORDS)
    out = scanned(docs, first, text_col, coverage, slack)
    for more in rest:
        held = fresh_name(out, "matches")
        out = scanned(out.withColumnRenamed("license_matches", held), more, text_col, coverage, slack)
        order = lambda x, y: F.when(F.struct(x["from_word"], x["template"]) < F.struct(y["from_word"], y["template"]), -1).otherwise(1)
        out = out.withColumn("license_matches", F.array_sort(F.concat(held, "license_matches"), order)).drop(held)
    return out


def scanned(docs: DataFrame, templates: dict[str, str], text_col: str, coverage: float, slack: float) -> DataFrame:
    """One pass over the texts, for one group of templates."""

    def make():
        scanner = Scanner(templates, coverage, slack)

        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            matches, counts = [], []
            for i, j, _, _, w in word_slices(batch.column(text_col)):
                seeds = np.flatnonzero(member(w.hash, scanner.keys) >= 0)
                cut = np.searchsorted(seeds, w.off)
                for r in range(j - i):
                    own = seeds[cut[r] : cut[r + 1]] - w.off[r]
                    found = scanner.from_seeds(w.hash[w.off[r] : w.off[r + 1]], own) if len(own) else []
                    matches.append([dict(zip(("template", "coverage", "from_word", "to_word"), m, strict=True)) for m in found])
                counts.append(np.diff(w.off))
            kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("from_word", pa.int64()), ("to_word", pa.int64())]))
            return {"license_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()), "license_matches": pa.array(matches, kind)}

        return fn

    return append_columns(docs, [T.StructField("license_words", T.LongType()), T.StructField("license_matches", MATCHES)], make, text_col)
