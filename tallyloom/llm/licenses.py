"""License scans with a generalised suffix automaton of the words of licence templates.

The automaton knows every run of words of every template.  A file's words stream
through it: after each word, the state and the length of the longest run that ends
there and stands in a template are the matching statistics.  Words that no template
holds end any run, so only stretches of template words are streamed; all others are
found at once for a whole chunk.  Maximal matches of some length chain into covered
spans of one template where their template places ascend and gaps are small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textcols import ALNUM, FIRST, Texts, Words, blocks, chunks, texts_of

#: Phrases that name a licence, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The opening or notice that each licence is known by.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
}
#: Words of the shortest match that counts, and words between two matches of one span at most.
LEAST_MATCH, MOST_GAP = 5, 8
#: Words that a span must cover, and the share of the template that gives its label.
LEAST_COVER, LEAST_SHARE = 12, 0.3


class Automaton:
    """The generalised suffix automaton of sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: For each state and sequence, the last places of all occurrences.
        self.ends: list[dict[int, set[int]]] = [{}]
        for s, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(s, set()).add(place)
        for state in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            for s, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(s, set()).update(places)

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the runs of q that are no longer than p's with word."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # the run stands in an earlier sequence
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """After each word: the state and the length of the longest run that ends there."""
        out, state, length = [], 0, 0
        follow, link, longest = self.next, self.link, self.length
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                length = longest[state]
            if word in follow[state]:
                state, length = follow[state][word], length + 1
            out.append((state, length))
        return out


def _block(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of words as numbers; zeros follow a word's end."""
    left = np.clip(words.end[at] - words.start[at] - 8 * k, 0, 8)
    return blocks(words.texts.data)[np.minimum(words.start[at] + 8 * k, len(words.texts.data))] & FIRST[left]


class Scanner:
    """Templates, phrases and their automaton; all sequences are runs of one vocabulary."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [*templates, *phrases.values()]
        texts = [*templates.values(), *phrases]
        self.n_templates = len(templates)
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
        sequences = [[vocabulary[w] for w in t.split()] for t in texts]
        self.sizes = [len(s) for s in sequences]
        self.automaton = a = Automaton(sequences)
        raw = texts_of(pa.array([" ".join(vocabulary)]))
        raw_words = Words(raw, ALNUM)
        known = raw_words.hashes()
        self.order = np.argsort(known)
        self.known = known[self.order]
        #: The vocabulary's words in blocks of eight bytes.
        self.lengths = raw_words.end - raw_words.start
        self.blocks = [_block(raw_words, np.arange(len(raw_words)), k) for k in range(-(-int(self.lengths.max()) // 8))]
        #: States of whole phrases, then for each state the phrases that any of its runs ends with.
        states = [a.statistics(s)[-1][0] for s in sequences[self.n_templates :]]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for v in range(1, len(a.link)):
            up = v
            while up > 0:
                self.phrases[v] += [(k, self.sizes[self.n_templates + k]) for k, s in enumerate(states) if s == up]
                up = a.link[up]

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary number of each word, -1 for all others; words whose hashes agree are compared by their bytes."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        number = np.where(self.known[at] == hashes, self.order[at], -1)
        hit = np.flatnonzero(number >= 0)
        same = words.end[hit] - words.start[hit] == self.lengths[number[hit]]
        for k, block in enumerate(self.blocks):
            same &= _block(words, hit, k) == block[number[hit]]
        number[hit[~same]] = -1
        return number

    def scan(self, numbers: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, tuple[int, ...]]]]:
        """Of a stretch of template words: phrases (first word, which), and maximal matches (first word, words, template, all its first words)."""
        found, matches = [], []
        a = self.automaton
        steps = a.statistics(numbers)
        for i, (state, length) in enumerate(steps):
            found += [(i - size + 1, k) for k, size in self.phrases[state] if length >= size]
            longest = i + 1 == len(steps) or steps[i + 1][1] <= length
            if longest and length >= LEAST_MATCH:
                matches += [(i - length + 1, length, s, tuple(place - length + 1 for place in places)) for s, places in a.ends[state].items() if s < self.n_templates]
        return found, matches

    def spans(self, matches: list[tuple[int, int, int, tuple[int, ...]]]) -> list[tuple[int, int, int, int]]:
        """Covered spans of one text: template, first word, end, words covered.

        A chain keeps all template places that its matches may have led to; a match goes on from those that one of its own continues.
        """
        out = []
        for s in range(self.n_templates):
            chain: tuple[int, int, int, list[int]] | None = None  # first, end, covered, template places behind it
            for first, size, _, places in sorted(m for m in matches if m[2] == s):
                if chain and first + size <= chain[1]:
                    continue
                near = chain is not None and first - chain[1] <= MOST_GAP
                on = [p + size for p in places if near and any(p + size > q and abs((p - q) - (first - chain[1])) <= MOST_GAP for q in chain[3])]
                if on:
                    chain = (chain[0], first + size, chain[2] + first + size - max(first, chain[1]), on)
                else:
                    if chain and chain[2] >= LEAST_COVER:
                        out.append((s, chain[0], chain[1], chain[2]))
                    chain = (first, first + size, size, [p + size for p in places])
            if chain and chain[2] >= LEAST_COVER:
                out.append((s, chain[0], chain[1], chain[2]))
        return out

    def rows(self, texts: Texts) -> Iterator[tuple]:
        """For each text: words, places of phrases, first and last of them, labels by phrases, all labels, score, spans."""
        words = Words(texts.lowered(), ALNUM)
        number = self.numbers(words)
        inside = number >= 0
        begins, ends = inside.copy(), inside.copy()
        edge = words.row[1:] != words.row[:-1]
        begins[1:] &= ~inside[:-1] | edge
        ends[:-1] &= ~inside[1:] | edge
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = ends - begins >= min(LEAST_MATCH, *self.sizes)
        begins, ends = begins[long], ends[long]
        of = words.row[begins] if len(begins) else begins
        edges = np.searchsorted(of, np.arange(len(texts) + 1))
        listed = number.tolist()
        for r, n in enumerate(words.counts().tolist()):
            found, matches, first = [], [], int(words.first[r])
            for lo, hi in zip(begins[edges[r] : edges[r + 1]].tolist(), ends[edges[r] : edges[r + 1]].tolist(), strict=True):
                places, runs = self.scan(listed[lo:hi])
                found += [(lo - first + i, k) for i, k in places]
                matches += [(lo - first + i, size, s, places) for i, size, s, places in runs]
            base = sorted({self.labels[self.n_templates + k] for _, k in found})
            spans = self.spans(matches) if matches else []
            share: dict[int, int] = {}
            for s, _, _, covered in spans:
                share[s] = max(share.get(s, 0), covered)
            ratio = {s: min(1.0, c / self.sizes[s]) for s, c in share.items()}
            labels = sorted({*base, *(self.labels[s] for s, x in ratio.items() if x >= LEAST_SHARE)})
            score = max([1.0 if base else 0.0, *ratio.values()])
            starts = [i for i, _ in found]
            yield n, len(found), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [{"label": self.labels[s], "first": lo, "end": hi, "covered": c} for s, lo, hi, c in spans]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long, covered: long>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base places are where a phrase's words stand consecutively.  A template adds its
    label where one span covers 30 hundredths of it; spans have their first word, their
    end and the words covered.  score is 1 with a base place, else the largest share of
    a template that a span covers.  A null or empty text has no words, empty labels,
    score 0.  No rows give no rows; equal rows each give theirs; other columns are ignored.
    """
    kinds = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())])
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(kinds)]
    names = [x.split()[0] for x in RESULT.split(", ")[:7]] + ["spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            columns = zip(*scanner().rows(texts), strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {RESULT}")
