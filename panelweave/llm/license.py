"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template. A file's tokens are streamed through it:
at each token it gives the longest run that ends there and stands in some template (the matching
statistics). Runs that can't be extended and are long enough become anchors, each with its places
in the templates; anchors of one template that follow each other in file and template, with small
gaps, are chained into a span, and a span that covers enough of its template is a finding. Enough is
meant by tokens and by their weights, a token weighing the less the more labels have it; of a short
template nearly all of the weight must be there, so that stop words alone are no finding. Phrases
are templates that must match in full; where one ends is read from the same statistics.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The automaton is built
on the driver from the templates (a few thousand tokens at most) and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, record_batch, slices

#: The phrases of the base scan, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Well-known notices and the first paragraphs of well-known licences, by label.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mit-notice": ("Released under the MIT License", "Licensed under the MIT License", "Licensed under the terms of the MIT License"),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
        "This work is licensed under the GNU General Public License, version 2",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
}

_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are lower-cased; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).translate(_WORD_BYTES).split() if text else []


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; state 0 is the empty run.

    ``ends[s]``: (sequence, end) of the places where the runs of state s end."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step), self.link.append(link), self.length.append(length), self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for p's longest run and c, cut out of a longer one if need be."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _append(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def add(self, number: int, sequence: list[int]) -> int:
        """Adds a sequence and returns the state of the whole of it."""
        last = 0
        for end, c in enumerate(sequence, 1):
            last = self._append(last, c)
            self.ends[last].append((number, end))
        return last

    def finish(self) -> None:
        """Gives each state the places of the states that have it as a suffix."""
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        for s, e in enumerate(self.ends):
            self.ends[s] = sorted(set(e))


@dataclass(frozen=True)
class Span:
    """A stretch ``[start, end)`` of a file's tokens chained to a template."""

    label: str
    start: int
    end: int
    covered: int
    coverage: float


class Scanner:
    """Finds phrases and template spans in a sequence of tokens."""

    def __init__(self, templates=None, phrases=None, least: int = 3, gap: int = 12, coverage: float = 0.6, short: int = 24, short_coverage: float = 0.85):
        templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
        self.least, self.gap, self.coverage = least, gap, coverage
        self.short, self.short_coverage = short, short_coverage
        self.ids: dict[bytes, int] = {}
        self.automaton = Automaton()
        self.labels, self.sizes, self.weights = [], [], []
        of_token: dict[bytes, set[str]] = {}
        for label, texts in templates.items():
            for w in {w for text in texts for w in tokens(text)}:
                of_token.setdefault(w, set()).add(label)
        number = lambda w: self.ids.setdefault(w, len(self.ids) + 1)
        for label, texts in templates.items():
            for text in texts:
                sequence = list(map(number, tokens(text)))
                self.automaton.add(len(self.labels), sequence)
                self.labels.append(label), self.sizes.append(len(sequence))
                # weights of the template's first tokens, added up
                self.weights.append(np.cumsum([0.0, *(1 / len(of_token[w]) ** 2 for w in tokens(text))]).tolist())
        ends = {}
        for phrase, label in phrases.items():
            sequence = list(map(number, tokens(phrase)))
            self.automaton.add(-1, sequence)
            ends[tuple(sequence)] = label
        self.automaton.finish()
        # phrases that end wherever a state's runs end; (words, label)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.link]
        for sequence, label in ends.items():
            s = 0
            for c in sequence:
                s = self.automaton.step[s][c]
            self.phrases[s].append((len(sequence), label))
        for s in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[s] = self.phrases[s] + self.phrases[self.automaton.link[s]]

    def statistics(self, words: list[bytes]):
        """``(position, state, length)`` of the longest match that ends at each token where there is one."""
        get, step, link, length = self.ids.get, self.automaton.step, self.automaton.link, self.automaton.length
        ids = np.array([get(w, 0) for w in words], np.int64)
        before, state, run = -2, 0, 0
        for i in np.flatnonzero(ids).tolist():
            c = int(ids[i])
            if i != before + 1:
                state, run = 0, 0
            while state and c not in step[state]:
                state = link[state]
                run = length[state]
            if c in step[state]:
                state, run = step[state][c], run + 1
                yield i, state, run
            before = i

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[Span]]:
        """Phrases as ``(start, label)`` in order, and the spans found."""
        found, anchors, pending = [], [], None
        for i, state, run in self.statistics(words):
            if self.phrases[state]:
                found += [(i - size + 1, label) for size, label in self.phrases[state] if size <= run]
            if pending and pending[0] >= self.least and not (pending[1] == i - 1 and run == pending[0] + 1):
                anchors.append(pending)
            pending = (run, i, state)
        if pending and pending[0] >= self.least:
            anchors.append(pending)
        return sorted(found), self._chain(anchors)

    def _chain(self, anchors: list[tuple[int, int, int]]) -> list[Span]:
        """Chains anchors (length, last token, state) template by template; the best predecessor is
        sought among those that end within ``gap`` tokens of the anchor's start."""
        by_template: dict[int, list[list[int]]] = {}
        for run, i, state in anchors:
            for number, end in self.automaton.ends[state]:
                if number >= 0:
                    by_template.setdefault(number, []).append([i - run + 1, i + 1, end - run, end])
        spans = []
        for number, places in by_template.items():
            size, weight, chains = self.sizes[number], self.weights[number], []
            places.sort(key=lambda p: (p[1], p[3]))
            first = 0
            for start, end, t_start, t_end in places:
                best = (end - start, start, weight[t_end] - weight[t_start])
                while first < len(chains) and chains[first][0] < start - self.gap - size:
                    first += 1
                for c_end, c_t_end, covered, c_start, c_weight in chains[first:]:
                    lap = max(0, c_end - start, c_t_end - t_start)
                    if start - c_end <= self.gap and 0 <= t_start - c_t_end + lap <= self.gap + lap and lap < end - start and t_end > c_t_end and end > c_end:
                        best = max(best, (covered + end - start - lap, c_start, c_weight + weight[t_end] - weight[t_start + lap]))
                chains.append((end, t_end, *best))
            best_at: dict[int, tuple[int, int]] = {}
            enough = (self.short_coverage if size <= self.short else self.coverage) * weight[-1]
            for e, _, c, s, w in chains:
                if c >= self.coverage * size and w >= enough - 1e-9:
                    best_at[s] = max(best_at.get(s, (0, 0)), (c, e))
            spans += [Span(self.labels[number], s, e, c, c / size) for s, (c, e) in best_at.items()]
        return sorted(spans, key=lambda x: (x.start, x.end, x.label))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])


def scan(docs: DataFrame, templates: dict | None = None, phrases: dict | None = None, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, from the whole text.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the phrases (null
    places without one, labels distinct, sorted, comma-joined); ``labels`` of phrases and templates;
    ``score``, the best coverage of a template, or 0.5 if only phrases were found, or 0; and
    ``spans``, the findings as ``label:start-end`` joined by commas. Null and empty texts have no
    word and no finding; null and repeated ids stay as they are; other columns play no part.
    """
    scanner = Scanner(templates, phrases, **options)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def row(doc_id, text):
        words = tokens(text)
        base, spans = shared.value(words)
        own = {label for _, label in base}
        score = max([0.5 if base else 0.0, *(min(1.0, s.coverage) for s in spans)])
        return (doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {s.label for s in spans})), score, ",".join(f"{s.label}:{s.start}-{s.end}" for s in spans))

    def run(batches):
        for batch in slices(batches):
            rows = [row(d, t) for d, t in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield record_batch(_SCHEMA, **dict(zip(_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
