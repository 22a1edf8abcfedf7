"""License scans: matching statistics of a text against a generalised suffix automaton of license words, chained to spans.

The automaton holds every substring of the templates and of the base phrases, as words. Reading a text gives, for each
place, the longest run of words ending there that some template holds. Runs of at least `min_match` words are chained, in
order within text and template, into the span of a template that the text covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused

#: Phrases and the labels they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Characteristic passages of well-known public licenses.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

SPANS = "array<struct<label: string, first_word: long, last_word: long, covered: double>>"
SCHEMA = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class SuffixAutomaton:
    """Of several word sequences. Each state has its longest length, its suffix link, and one end place in every sequence that holds it."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for number, words in enumerate(sequences):
            last = 0
            for place, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(number, place)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                for number, place in self.ends[s].items():
                    self.ends[self.link[s]].setdefault(number, place)

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the part of q that p reaches by w."""
        clone = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest run ending there."""
        state = size = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            yield state, size


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], min_match: int, min_cover: float):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.labels, bodies = list(templates), [words_of(t) for t in templates.values()]
        self.sizes, self.min_match, self.min_cover = [len(b) for b in bodies], min_match, min_cover
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for b in [*bodies, *(p for p, _ in self.phrases)] for w in b))}
        self.shortest = min([min_match, *(len(p) for p, _ in self.phrases)])  # fewer known words in a row are no phrase and no run
        to_ids = lambda ws: [self.ids[w] for w in ws]
        self.automaton = a = SuffixAutomaton([to_ids(b) for b in bodies] + [to_ids(p) for p, _ in self.phrases])
        self.found: list[tuple[tuple[int, str], ...]] = []  # of each state: the phrases that end it
        at = {}
        for p, label in self.phrases:
            s = 0
            for w in to_ids(p):
                s = a.next[s][w]
            at.setdefault(s, []).append((len(p), label))
        for s in range(len(a.next)):
            up, got = s, []
            while up > 0:
                got += at.get(up, [])
                up = a.link[up]
            self.found.append(tuple(got))

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        ids = list(map(self.ids.get, words))
        places, base, runs = [], set(), []
        lo = 0
        while lo < len(ids):
            if ids[lo] is None:
                lo += 1
                continue
            hi = lo + 1
            while hi < len(ids) and ids[hi] is not None:
                hi += 1
            if hi - lo >= self.shortest:
                self._read(ids, lo, hi, places, base, runs)
            lo = hi
        spans = self._chained(runs)
        labels = sorted(base | {s[0] for s in spans})
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, [dict(zip(("label", "first_word", "last_word", "covered"), s, strict=True)) for s in spans])

    def _read(self, ids: list, lo: int, hi: int, places: list, base: set, runs: list) -> None:
        before = None
        for at, (state, size) in enumerate(self.automaton.statistics(ids[lo:hi]), lo):
            for n, label in self.found[state]:
                if n <= size:
                    places.append(at - n + 1)
                    base.add(label)
            if before and size != before[1] + 1 and before[1] >= self.min_match:
                runs.append((at - 1, *before))
            before = (state, size)
        if before and before[1] >= self.min_match:
            runs.append((hi - 1, *before))

    def _chained(self, runs: list) -> list[tuple[str, int, int, float]]:
        """For each template the chains of its runs that cover it far enough, best first, without overlap."""
        spans = []
        for t, label in enumerate(self.labels):
            own = [(end - size + 1, end, ends[t] - size + 1, ends[t]) for end, state, size in runs if t in (ends := self.automaton.ends[state])]
            best: list[tuple[int, int]] = []  # words covered, first word
            for i, (first, end, t_first, t_end) in enumerate(own):
                cover = (end - first + 1, first)
                for j in range(i - 1, -1, -1):
                    if first - own[j][1] > self.sizes[t]:
                        break  # runs stand in the order of their ends, so all before are too far as well
                    if own[j][3] < t_end and own[j][1] < end:
                        new = min(t_end - max(own[j][3], t_first - 1), end - max(own[j][1], first - 1))
                        cover = max(cover, (best[j][0] + new, best[j][1]))
                best.append(cover)
            kept: list[tuple[int, int]] = []
            for covered, i in sorted(((c[0], -i) for i, c in enumerate(best)), reverse=True):
                share = min(1.0, covered / self.sizes[t])
                if share < self.min_cover:
                    break
                first, end = best[-i][1], own[-i][1]
                if all(end < a or b < first for a, b in kept):
                    kept.append((first, end))
                    spans.append((label, first, end, share))
        return spans


def scan_licenses(df: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, min_match: int = 5, min_cover: float = 0.3) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans for each whole text.

    A label of the method needs a chain that covers `min_cover` of its template. Score: 1 if a base phrase occurs, else the
    largest share of a template that is covered. spans: the chains that cover so much, those of a template without overlap.
    Repeated rows are scanned each; an empty table gives no rows. Null and empty texts: no words, no labels, score 0, no spans. Columns of
    these names that `df` has already are replaced.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    @F.pandas_udf(SCHEMA)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates, min_match, min_cover)
        for texts in batches:
            out = pd.DataFrame([scanner.scan(t) for t in texts], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    keep = [c for c in df.columns if c not in names]
    (own,) = unused(keep, "scan")
    return df.select(*keep, scanned(F.col(text)).alias(own)).select(*keep, *[f"{own}.{n}" for n in names])
