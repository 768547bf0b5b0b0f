"""Licence scans by a generalised suffix automaton of licence templates.

One automaton holds all templates' words. A document's words are streamed
through it and give matching statistics: at each word the longest run ending
there that occurs in some template. Long runs are cut out and chained, per
template, in the order of text and template; the template words that a chain
covers, over the template's length, is the template's coverage. A document
gets a template's label from ``COVERED`` on, besides the labels of the fixed
phrases. Only words of some template enter the automaton; all others reset it,
so a document costs what its licence-like runs cost.

Defined results: words are lower-cased (A-Z) runs of digits, letters and
characters beyond ASCII; NULL and empty texts have no words and no labels; of
equal chains the first template wins; repeated rows and NULL ids pass; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kestrel.llm import kernels as K
from kestrel.llm.tables import texts

# Phrases and labels of the base rule.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short passages of public licence notices and texts.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)
MIN_RUN = 3
COVERED = 0.8


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """Suffix automaton of several sequences of word numbers (from 0)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of a state's longest run
        for k, seq in enumerate(sequences):
            last = 0
            for end, w in enumerate(seq, 1):
                last = self._extend(last, w)
                state = last
                while state > 0 and (k, end) not in self.places[state]:
                    self.places[state].add((k, end))
                    state = self.link[state]

    def _new(self, length: int, link: int, following: dict[int, int], places: set) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.places.append(places)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), set(self.places[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}, set()), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """At each word the state and length of the longest run ending there."""
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append((state, n))
        return out


class Templates:
    """The automaton and the words of all templates."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _ in templates]
        sequences = [split_words(t) for _, t in templates]
        self.sizes = [len(s) for s in sequences]
        self.words = list(dict.fromkeys(w for s in sequences for w in s))
        number = {w: i for i, w in enumerate(self.words)}
        self.automaton = Automaton([[number[w] for w in s] for s in sequences])
        hashes = word_hashes(self.words)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Template word numbers of word hashes, -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def runs(self, words: list[int], offset: int) -> list[tuple[int, int, int, int]]:
        """Maximal matches ``(template, template start, text start, length)`` in
        a run of template words that begins at word ``offset``."""
        stats = self.automaton.statistics(words)
        out = []
        for i, (state, n) in enumerate(stats):
            if n and (i + 1 == len(stats) or stats[i + 1][1] != n + 1):
                for k, end in self.automaton.places[state]:
                    if n >= min(MIN_RUN, self.sizes[k]):
                        out.append((k, end - n, offset + i + 1 - n, n))
        return out

    def coverages(self, runs: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Template to ``(coverage, first word, last word)`` of its best chain.
        A chain's next match starts after the one before in text and template,
        and within two template lengths of it in the text."""
        by: dict[int, list] = {}
        for k, a, b, n in runs:
            by.setdefault(k, []).append((b, a, n))
        out = {}
        for k, found in by.items():
            found = sorted(set(found))
            best = (0.0, 0, 0)
            chains: list[tuple[int, int, int, int]] = []  # text end, template end, covered, first word
            for b, a, n in found:
                chains = [c for c in chains if c[0] + 2 * self.sizes[k] >= b]
                own = max(((c[2] + n, c[3]) for c in chains if c[0] <= b and c[1] <= a), default=(n, b))
                if own[0] < n:
                    own = (n, b)
                chains.append((b + n, a + n, *own))
                best = max(best, (own[0] / self.sizes[k], own[1], b + n - 1), key=lambda x: x[0])
            out[k] = best
        return out


def word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    data = np.frombuffer(b" ".join(raw), np.uint8)
    return K.hash_spans(data, ends - np.array([len(r) for r in raw]), ends)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans``: ``score`` is the largest coverage (1 with a base phrase),
    ``spans`` the chains of the labelled templates with their word ranges."""

    def rows(batches):
        known = Templates(templates)
        phrases = [word_hashes(p.split()) for p, _ in PHRASES]
        for b in batches:
            for lo, hi, data, off in K.text_slices(b.column(1)):
                h, _, _, first = K.words(K.lower(data), off, K.ALNUM_BYTES)
                row_of = np.repeat(np.arange(hi - lo), np.diff(first))
                n_base = np.zeros(hi - lo, np.int64)
                first_at, last_at = np.full(hi - lo, np.iinfo(np.int64).max), np.full(hi - lo, -1)
                base: list[set[str]] = [set() for _ in range(hi - lo)]
                for (_, label), words in zip(PHRASES, phrases, strict=True):
                    n = max(0, len(h) - len(words) + 1)
                    hit = np.ones(n, bool)
                    for j, w in enumerate(words):
                        hit &= h[j:j + n] == w
                    at = np.flatnonzero(hit)
                    at = at[row_of[at] == row_of[at + len(words) - 1]]
                    r, place = row_of[at], at - first[row_of[at]]
                    np.add.at(n_base, r, 1)
                    np.minimum.at(first_at, r, place)
                    np.maximum.at(last_at, r, place)
                    for i in set(r.tolist()):
                        base[i].add(label)
                number = known.numbers(h)
                inside = np.flatnonzero(number >= 0)
                new = np.ones(len(inside), bool)
                new[1:] = (np.diff(inside) != 1) | (row_of[inside[1:]] != row_of[inside[:-1]])
                cuts = np.append(np.flatnonzero(new), len(inside))
                size = np.diff(cuts)
                runs: dict[int, list] = {}
                for c in np.flatnonzero(size >= min(MIN_RUN, *known.sizes)):
                    at = inside[cuts[c]]
                    r = int(row_of[at])
                    got = known.runs(number[at:at + size[c]].tolist(), int(at - first[r]))
                    if got:
                        runs.setdefault(r, []).extend(got)
                labels, scores, spans = [], [], []
                for i in range(hi - lo):
                    cover = known.coverages(runs[i]) if i in runs else {}
                    good = {k: c for k, c in cover.items() if c[0] >= COVERED}
                    labels.append(",".join(sorted(base[i] | {known.labels[k] for k in good})))
                    scores.append(1.0 if base[i] else max((c[0] for c in cover.values()), default=0.0))
                    spans.append([{"label": known.labels[k], "coverage": c[0], "first": c[1], "last": c[2]} for k, c in sorted(good.items())])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(n_base), pa.array(first_at, mask=n_base == 0), pa.array(last_at, mask=n_base == 0),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array(labels), pa.array(scores, pa.float64()), pa.array(spans, SPANS),
                ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return texts(df, id_col, text_col).mapInArrow(rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,coverage:double,first:long,last:long>>")


SPANS = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
