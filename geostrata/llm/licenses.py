"""License scans with one suffix automaton of all license texts.

The automaton holds every run of words of every template. A file is streamed through it word by word, which gives its
matching statistics: at each place, the longest run of words ending there that some template holds. Runs that the
next word does not lengthen are matches; long ones are placed in each template that holds them, by the automaton's
suffix links, and chained: matches that follow each other in file and template, with small gaps in both, are
one copy with edits. A chain that covers enough of a template's words is a span of that license. Phrases are templates
that count only as a whole; a phrase ends where the state reached, or one on its suffix links, is the phrase's own.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import small_batches

# The phrases and their labels, and public license notices with theirs.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
#: Words of a match at least (or a whole template, if it has fewer), words between two matches of a chain at most, and the share of a template's words that a span covers at least.
LEAST, GAP, COVER = 4, 24, 0.6
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased letters and everything beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class LicenseAutomaton:
    """The suffix automaton of several sequences of words: states by number, 0 the empty run."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words_of(text)) for _, text in templates]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}  # state of a prefix of a template: (template, words)
        for k, (_, text) in enumerate(templates):
            last = 0
            for n, word in enumerate(words_of(text)):
                last = self._extend(last, word)
                ends.setdefault(last, []).append((k, n + 1))
        whole: dict[int, list[tuple[int, str]]] = {}
        for label, text in phrases:
            last = 0
            for word in words_of(text):
                last = self._extend(last, word)
        self.least = min([LEAST, *self.sizes])
        self._tour(ends)
        for label, text in phrases:
            state, words = 0, words_of(text)
            for word in words:
                state = self.next[state][word]
            whole.setdefault(state, []).append((len(words), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.phrases[self.link[state]] if state else []
            self.phrases[state] = above + whole.get(state, [])

    def _new(self, length: int, link: int, arcs: dict[bytes, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, to: int) -> int:
        """The state of the longest run of `state` and then word: `to` itself, or what is split off it for its shorter runs."""
        if self.length[to] == self.length[state] + 1:
            return to
        part = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = part
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        if (there := self.next[last].get(word)) is not None:
            return self._split(last, word, there)
        new = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def _tour(self, ends: dict[int, list[tuple[int, int]]]) -> None:
        """Lays out the places of prefixes along the tree of suffix links, so that a state's places are one slice."""
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self.places: list[tuple[int, int]] = []
        self.slice = [(0, 0)] * len(self.next)
        stack = [(0, False)]
        begun = [0] * len(self.next)
        while stack:
            state, done = stack.pop()
            if done:
                self.slice[state] = (begun[state], len(self.places))
                continue
            begun[state] = len(self.places)
            self.places += ends.get(state, [])
            stack.append((state, True))
            stack += [(x, False) for x in below[state]]

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the longest run of words ending there that the automaton holds."""
        arcs, link, size = self.next, self.link, self.length
        state = n = 0
        for word in words:
            to = arcs[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = arcs[state].get(word)
                n = size[state]
            state, n = (to, n + 1) if to is not None else (0, 0)
            yield state, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Phrases as (label, start), and spans as (label, start, end, share of the template covered), ends exclusive; both sorted."""
        phrases, anchors = [], {}
        held, had, at = 0, 0, 0
        for state, n in self.statistics(words):
            if n <= had and had >= self.least:
                self._place(anchors, held, had, at)
            at += 1
            if self.phrases[state]:
                phrases += [(label, at - size) for size, label in self.phrases[state] if size <= n]
            held, had = state, n
        if had >= self.least:
            self._place(anchors, held, had, at)
        spans = [x for template, found in anchors.items() for x in self._chains(template, found)]
        return sorted(phrases, key=lambda x: (x[1], x[0])), sorted(spans, key=lambda x: (x[1], x[2], x[0]))

    def _place(self, anchors: dict, state: int, n: int, end: int) -> None:
        begin, stop = self.slice[state]
        for template, there in self.places[begin:stop]:
            if n >= min(LEAST, self.sizes[template]):
                anchors.setdefault(template, []).append((end - n, there - n, n))

    def _chains(self, template: int, anchors: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains that cover enough of the template, those that cover most first; a later one that meets an earlier is left out."""
        best, back, first = [], [], 0
        for k, (here, there, n) in enumerate(anchors):
            while anchors[first][0] + self.sizes[template] + GAP < here:  # no match is longer than its template
                first += 1
            most, of = n, -1
            for j in range(first, k):
                here0, there0, n0 = anchors[j]
                if here0 < here and there0 < there and here - here0 - n0 <= GAP and there - there0 - n0 <= GAP:
                    gain = n - max(0, here0 + n0 - here, there0 + n0 - there)
                    if gain > 0 and best[j] + gain > most:
                        most, of = best[j] + gain, j
            best.append(most)
            back.append(of)
        out: list[tuple[int, int, float]] = []  # by start
        for k in sorted(range(len(anchors)), key=lambda k: (-best[k], anchors[k])):
            if best[k] < COVER * self.sizes[template]:
                break
            begin, end = k, anchors[k][0] + anchors[k][2]
            while back[begin] >= 0:
                begin = back[begin]
            start = anchors[begin][0]
            at = bisect.bisect(out, (start,))
            if (at == 0 or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0]):
                out.insert(at, (start, end, best[k] / self.sizes[template]))
        return [(self.labels[template], *x) for x in out]


@functools.cache
def _automaton(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> LicenseAutomaton:
    """One automaton for all tasks that a Python worker runs."""
    return LicenseAutomaton(list(templates), list(phrases))


def scan_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (all, if None) with n_words, phrases (label, start) and spans (label, start, end, cover).

    Starts and ends count words from 0, ends exclusive; cover is the share of a template's words in the span. Null and empty
    texts have no words, phrases or spans. Texts are scanned whole, however long; of spans of one template that
    meet, the one that covers most stays, then the first. Repeated rows are scanned each for itself, alike;
    columns called like an added one are given in its place; null in other columns is kept; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    added = {"n_words": "long", "phrases": "array<struct<label:string,start:long>>", "spans": "array<struct<label:string,start:long,end:long,cover:double>>"}
    kept = [x for x in (docs.columns if keep is None else keep) if x not in added]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("text"))
    names, chosen = (tuple(map(tuple, x)) for x in (templates, phrases))
    phrase = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names, chosen)
        for batch in batches:
            counts, found, spans = [], [], []
            for x in batch.column(1):
                words = words_of(x.as_py())
                some, more = automaton.scan(words)
                counts.append(len(words))
                found.append([{"label": a, "start": b} for a, b in some])
                spans.append([{"label": a, "start": b, "end": c, "cover": d} for a, b, c, d in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, phrase), pa.array(spans, span)], names=["row", *added])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in added.items()))
    return out.select(*[F.col(f"row.`{c}`") for c in kept], *added)


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """Phrases, labels and the best cover of a license in every document; a phrase covers itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_licenses(docs, keep=["doc_id"])
    base = F.array_sort(F.array_distinct("phrases.label"))
    every = F.array_sort(F.array_distinct(F.concat("phrases.label", "spans.label")))
    score = F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.start").alias("first_word"), F.array_max("phrases.start").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
