"""Licence scan by a generalised suffix automaton of licence words and chained matches.

The words of all templates and phrases are read into one suffix automaton, small and sent to every task. A text streams
through it word by word: the state and the number of words matched tell, at every word, the longest passage ending there
that stands in some template. Where a match cannot go on it is noted; where a phrase's state lies on the suffix links of
the state, the phrase stands. Only words that follow one another in some template can be in a match of two words, so
the automaton reads no others.

Noted matches of ``MATCH`` words or more are laid on every place of the template where they stand, and chained in the
order of text and template with gaps of at most ``GAP`` words on both sides. A chain that covers ``SHARE`` of a template
is a span. Of spans of different templates that share text, the one with more covered words stays, so that a notice of
version 3 isn't one of version 2 as well.

Cost is linear in the text; chains look back no farther than the gap. Texts are never cut and nothing is shuffled.

Defined cases: null and empty texts have no words and no finds; a null key stays null; repeated rows are repeated in the
result; an empty table gives an empty result; other columns are ignored. Of equal spans the one with the larger share,
then the smaller label, stays.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W

MATCH = 3
GAP = 24
SHARE = 0.6

# Phrases that name a licence.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public licence notices, by their usual short names; a label may have several.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

Match = tuple[int, int, int]  # first word in the text, first word in the template, words


def is_separator(data: np.ndarray) -> np.ndarray:
    """ASCII bytes other than a-z and 0-9 (texts are lower-cased before)."""
    return (data < 128) & ~(((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)))


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """Generalised suffix automaton of some sequences of numbers, and the places of every state's words."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, sequence, words up to there
        for number, sequence in enumerate(sequences):
            last = 0
            for k, c in enumerate(sequence, 1):
                last = self._extend(last, c)
                ends.append((last, number, k))
        self._lay_out(ends)
        self.whole = {}  # the state of each whole sequence
        for state, number, k in ends:
            if k == len(sequences[number]):
                self.whole[number] = state

    def _new(self, steps: dict[int, int], length: int, link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _copied(self, at: int, c: int, to: int) -> int:
        """A state for what ``to`` holds up to the words that end at ``at``, put in its place."""
        copy = self._new(dict(self.steps[to]), self.length[at] + 1, self.link[to])
        self.link[to] = copy
        while at >= 0 and self.steps[at].get(c) == to:
            self.steps[at][c] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, c: int) -> int:
        to = self.steps[last].get(c)
        if to is not None:  # another sequence has been here
            return to if self.length[to] == self.length[last] + 1 else self._copied(last, c, to)
        new, at = self._new({}, self.length[last] + 1, 0), last
        while at >= 0 and c not in self.steps[at]:
            self.steps[at][c] = new
            at = self.link[at]
        if at >= 0:
            to = self.steps[at][c]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._copied(at, c, to)
        return new

    def _lay_out(self, ends: list[tuple[int, int, int]]) -> None:
        """All places in the order of a walk over the suffix links: those of a state and below it lie in a row."""
        children, own = defaultdict(list), defaultdict(list)
        for state, up in enumerate(self.link):
            children[up].append(state)
        for state, number, k in ends:
            own[state].append((number, k))
        self.places, self.span = [], [(0, 0)] * len(self.link)
        stack = [(0, False)]
        begin = {}
        while stack:
            state, done = stack.pop()
            if done:
                self.span[state] = (begin[state], len(self.places))
                continue
            begin[state] = len(self.places)
            self.places += own[state]
            stack.append((state, True))
            stack += [(child, False) for child in children[state]]

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, words up to there) of every place where the state's words end."""
        return self.places[slice(*self.span[state])]

    def statistics(self, numbers: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, words matched) after every number; numbers that no sequence has lead back to the start."""
        steps, link, length = self.steps, self.link, self.length
        state, matched = 0, 0
        for c in numbers:
            while state and c not in steps[state]:
                state = link[state]
                matched = length[state]
            if c in steps[state]:
                state, matched = steps[state][c], matched + 1
            yield state, matched


def chains(matches: list[Match], gap: int) -> list[list[Match]]:
    """Disjoint chains of the matches of one template, each increasing in text and template, the heaviest first.

    A match is worth the words that it adds: where it overlaps its predecessor on either side, these are taken off its
    front. A predecessor ends at most ``gap`` words before it, on both sides.
    """
    matches = sorted(matches)
    best, before, first = [], [], 0
    for k, (x, y, n) in enumerate(matches):
        # Matches begin in order, but a long one may still reach here: none before ``first`` does.
        while first < k and matches[first][0] + matches[first][2] + gap < x:
            first += 1
        value, origin = n, -1
        for j in range(first, k):
            px, py, pn = matches[j]
            if py >= y or px >= x or px + pn + gap < x or py + pn + gap < y:
                continue
            new = n - max(0, px + pn - x, py + pn - y)
            if new > 0 and best[j] + new > value:
                value, origin = best[j] + new, j
        best.append(value)
        before.append(origin)
    used, out = [False] * len(matches), []
    for k in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(matches[k])
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def covered(chain: list[Match]) -> tuple[int, int, int]:
    """(first word in the text, word after the last, covered words) of a chain."""
    total, at_x, at_y = 0, 0, 0
    for k, (x, y, n) in enumerate(chain):
        total += n - (max(0, at_x - x, at_y - y) if k else 0)
        at_x, at_y = x + n, y + n
    return chain[0][0], at_x, total


class Scanner:
    """Phrases and templates as one automaton, with what a task needs to find them in words given by their hashes."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]], match: int, gap: int, share: float):
        self.match, self.gap, self.share = match, gap, share
        said = [(label, tokens(text)) for text, label in phrases.items()]
        if any(len(words) < 2 for _, words in said):
            raise ValueError("a phrase has two words at least")
        known = [(label, tokens(text)) for label, texts in templates.items() for text in texts]
        words = sorted({w for _, own in [*said, *known] for w in own})
        number = {w: k for k, w in enumerate(words)}
        coded = [[number[w] for w in own] for _, own in [*said, *known]]
        self.labels, self.sizes = [label for label, _ in [*said, *known]], [len(c) for c in coded]
        self.first_template = len(said)
        self.automaton = Automaton(coded)
        # Phrases that end where a state's words end, down the suffix links.
        self.said: list[list[int]] = [[] for _ in self.automaton.link]
        for k in range(len(said)):
            self.said[self.automaton.whole[k]].append(k)
        for state in sorted(range(1, len(self.said)), key=self.automaton.length.__getitem__):
            self.said[state] += self.said[self.automaton.link[state]]
        raw, size = [w.encode() for w in words], len(words)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        hashes = W.byte_span_hash(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]) if raw else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.size = hashes[order], order, size
        self.pairs = np.unique(np.array([a * size + b for c in coded for a, b in zip(c, c[1:])], np.int64))

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that nothing here has."""
        if not self.size:
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[place] == hashes, self.numbers[place], -1)

    def stretches(self, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs of words of which each two neighbours follow one another in some template."""
        joined = np.zeros(len(codes) + 1, bool)  # whether a word goes on from the word before
        if len(codes) > 1:
            near = np.flatnonzero((codes[1:] >= 0) & (codes[:-1] >= 0) & (rows[1:] == rows[:-1]))
            joined[near + 1] = np.isin(codes[near] * self.size + codes[near + 1], self.pairs)
        return np.flatnonzero(joined[1:] & ~joined[:-1]), np.flatnonzero(joined[:-1] & ~joined[1:]) + 1

    def finds(self, stretches: list[tuple[int, list[int]]]) -> tuple[list[tuple], list[tuple]]:
        """Of one text, from its stretches (first word, numbers): places (label, start, words) and spans (label, start,
        words, covered words, share of the template)."""
        said, matches = [], defaultdict(list)
        length = self.automaton.length
        for first, numbers in stretches:
            last_state, last = 0, 0
            for k, (state, matched) in enumerate([*self.automaton.statistics(numbers), (0, 0)]):
                if matched <= last and last >= self.match:
                    for sequence, end in self.automaton.ends(last_state):
                        if sequence >= self.first_template:
                            matches[sequence].append((first + k - last, end - last, last))
                said += [(self.labels[p], first + k + 1 - self.sizes[p], self.sizes[p]) for p in self.said[state] if self.sizes[p] <= matched]
                last_state, last = state, matched
        spans = []
        for sequence, own in matches.items():
            for chain in chains(own, self.gap):
                start, end, total = covered(chain)
                if total >= self.share * self.sizes[sequence]:
                    spans.append((self.labels[sequence], start, end - start, total, total / self.sizes[sequence]))
        return sorted(said, key=lambda x: (x[1], x[0])), resolved(spans)


def resolved(spans: list[tuple]) -> list[tuple]:
    """Spans that share no text: of those that do, the one with the most covered words, by text."""
    starts, kept = [], []
    from bisect import bisect

    for span in sorted(spans, key=lambda s: (-s[3], -s[4], s[0], s[1])):
        k = bisect(starts, span[1])
        if (k == 0 or kept[k - 1][1] + kept[k - 1][2] <= span[1]) and (k == len(kept) or span[1] + span[2] <= kept[k][1]):
            starts.insert(k, span[1])
            kept.insert(k, span)
    return kept


PLACE, SPAN = "struct<label:string,start:bigint,words:bigint>", "struct<label:string,start:bigint,words:bigint,covered:bigint,share:double>"


def license_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES,
    match: int = MATCH, gap: int = GAP, share: float = SHARE,
) -> DataFrame:
    """(key, n_words, places, spans) per row: where phrases stand, and the covered spans of templates, by word number."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, match, gap, share))

    def lists(found: list[list[tuple]], names: list[str], kinds: list[pa.DataType]) -> pa.ListArray:
        flat = [x for own in found for x in own]
        items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)], names)
        return W.list_array(items, np.concatenate([[0], np.cumsum([len(own) for own in found])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for block, data, offsets in W.blocks(batches, "text"):
            low = W.lower_ascii(data)
            starts, ends, rows = W.pieces(low, offsets, is_separator(low))
            codes = scanner.coded(W.byte_span_hash(low, starts, ends))
            base = np.searchsorted(rows, np.arange(len(offsets)))
            by_row = defaultdict(list)
            for a, b in zip(*(x.tolist() for x in scanner.stretches(codes, rows))):
                row = int(rows[a])
                by_row[row].append((a - int(base[row]), codes[a:b].tolist()))
            finds = [scanner.finds(by_row[row]) if row in by_row else ([], []) for row in range(len(offsets) - 1)]
            whole, text_kind = pa.int64(), pa.string()
            places = lists([f[0] for f in finds], ["label", "start", "words"], [text_kind, whole, whole])
            spans = lists([f[1] for f in finds], ["label", "start", "words", "covered", "share"], [text_kind, whole, whole, whole, pa.float64()])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(base)), places, spans], ["key", "n_words", "places", "spans"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_words bigint, places array<{PLACE}>, spans array<{SPAN}>").withColumnRenamed("key", key)
