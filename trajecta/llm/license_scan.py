"""License scans: matching statistics of texts against a generalised suffix automaton.

The automaton holds the word sequences of the licence templates below, separated
so that no match crosses two templates.  A text's words are streamed through it;
wherever a template's own match stops growing, and is ``MIN_MATCH`` words or more, it
is placed (the automaton's suffix links lead to matches inside longer ones); places
are chained in text order per template (positions ascending in text and template,
gaps of ``MAX_GAP`` words at most).  A chain gives the template's label if it covers
``COVER`` of its words and of the words that no template of another label has; of
a template under ``SHORT`` words it must cover all, as such sentences share most of
their words with common speech.

Independently, a base phrase (words in a row) gives its label wherever it stands.

Defined cases: NULL and empty texts have no words and no label; repeated rows
are scanned alike; other columns are not read.  Texts are scanned whole.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from trajecta.llm.common import map_slices, texts_of

MIN_MATCH = 3
MAX_GAP = 12
COVER = 0.6
SHORT = 16

# Phrases that decide on their own, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence texts, and notices that licences ask to be put in a work, as published.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
            "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
            "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
            "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
            "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
            "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
             "this software for any purpose, including commercial applications, and to alter it and redistribute it "
             "freely, subject to the following restrictions"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
            "for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the "
               "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted, provided that the above copyright notice and this permission notice "
            "appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or "
            "neighboring rights to this work"),
    ("proprietary", "All rights reserved."),
]

# Every byte that ends a word becomes a space, A-Z their lower case.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word sequences.

    A state stands for the subsequences with the same end places; ``ends`` holds
    those as (sequence, position) so that a match can be placed in its templates.
    """

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set] = [set()]
        for s, words in enumerate(sequences):
            last = 0
            for p, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((s, p))
        # a suffix ends wherever the longer match ends
        for state in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state reached from ``at`` by ``word`` whose longest member is one longer than ``at``'s."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._new(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at != -1 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._new(self.length[last] + 1, {}, 0), last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            self.link[new] = self._split(at, word)
        return new

    def statistics(self, words: list[bytes]):
        """(state, length) of the longest match ending at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield state, length


class Scanner:
    """The automaton over all templates, and what tells them apart."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.sequences = [words_of(text.encode()) for _, text in templates]
        self.automaton = Automaton(self.sequences)
        self.vocabulary = frozenset(w for s in self.sequences for w in s)
        self.own: list[frozenset] = []  # places of a template whose word no other label has
        for label, words in zip(self.labels, self.sequences):
            others = {w for other, s in zip(self.labels, self.sequences) if other != label for w in s}
            self.own.append(frozenset(i for i, w in enumerate(words) if w not in others))

    def matches(self, words: list[bytes], min_match: int = MIN_MATCH) -> list[tuple[int, int, int, int]]:
        """(template, start in the text, start in the template, length) of every match that grows
        to neither side.

        Words outside the templates' vocabulary end every match, so only runs of
        vocabulary words are streamed.
        """
        automaton, sequences = self.automaton, self.sequences
        found, at, n = [], 0, len(words)
        marks = [i for i, w in enumerate(words) if w not in self.vocabulary]
        for stop in (*marks, n):
            if stop - at >= min_match:
                for i, (state, length) in enumerate(automaton.statistics(words[at:stop]), at):
                    after = words[i + 1] if i + 1 < stop else None
                    known: set = set()
                    while length >= min_match:
                        for t, p in automaton.ends[state] - known:
                            if p + 1 == len(sequences[t]) or sequences[t][p + 1] != after:
                                found.append((t, i - length + 1, p - length + 1, length))
                        known |= automaton.ends[state]
                        state = automaton.link[state]
                        length = automaton.length[state]
            at = stop + 1
        return found

    def accepts(self, t: int, covered: set[int], cover: float) -> bool:
        """Whether the covered places of a template give its label."""
        size = len(self.sequences[t])
        least = 1.0 if size < SHORT else cover
        return len(covered) >= least * size and len(covered & self.own[t]) >= least * len(self.own[t])


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(TEMPLATES)


def spans(words: list[bytes], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
          cover: float = COVER, known: Scanner | None = None) -> list[tuple[str, int, int, float]]:
    """(label, first word, last word, coverage) of every chain that covers enough of its template."""
    known = known or scanner()
    out: list[tuple[str, int, int, float]] = []
    by_template: dict[int, list] = {}
    for t, start, place, length in known.matches(words, min_match):
        by_template.setdefault(t, []).append((start, place, length))
    for t, places in by_template.items():
        chains: list[list] = []  # first word, end in text, end in template, places covered
        near: list[list] = []  # those that can still grow: places come in text order
        for start, place, length in sorted(places):
            near = [c for c in near if start - c[1] <= max_gap]
            fits = [c for c in near if start >= c[1] and 0 <= place - c[2] <= max_gap]
            here = range(place, place + length)
            if fits:
                best = max(fits, key=lambda c: len(c[3]))
                best[1:3] = [start + length, place + length]
                best[3].update(here)
            else:
                near.append([start, start + length, place + length, set(here)])
                chains.append(near[-1])
        out += [(known.labels[t], c[0], c[1] - 1, len(c[3]) / len(known.sequences[t]))
                for c in chains if known.accepts(t, c[3], cover)]
    return out


def phrase_places(words: list[bytes]) -> list[tuple[str, int, int]]:
    """(label, first word, words) of every place where a base phrase stands."""
    found = []
    for phrase, label in PHRASES.items():
        wanted = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(wanted[-1], at + 1)
            except ValueError:
                break
            if at + 1 >= len(wanted) and words[at + 1 - len(wanted):at + 1] == wanted:
                found.append((label, at + 1 - len(wanted), len(wanted)))
    return found


def scan(docs: DataFrame, cover: float = COVER) -> DataFrame:
    """Per row: words, base phrases, labels, score and the labelled spans.

    score is the largest coverage of a template, 1 where a base phrase stands.
    """
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
             "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
             "score": pa.float64(), "spans": pa.list_(pa.string())}

    def read(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in types}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            words = words_of(text)
            base = phrase_places(words)
            starts = [s for _, s, _ in base]
            chains = sorted(spans(words, cover=cover), key=lambda c: (c[1], c[2], c[0]))
            base_labels = {label for label, _, _ in base}
            row = (doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                   ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {c[0] for c in chains})),
                   1.0 if base else max((c[3] for c in chains), default=0.0),
                   [f"{label}:{a}-{b}:{share:.3f}" for label, a, b, share in chains])
            for c, v in zip(types, row):
                out[c].append(v)
        return out

    return map_slices(docs.select("doc_id", "text"), read, types)
