"""License scans with a generalised suffix automaton of licence words.

All templates (notices, header lines and the base phrases) go into one automaton of words. Each whole text is streamed
through it, which gives at every word the longest stretch ending there that occurs in some template (the
matching statistics); the states above it give the longest such stretch of each template. Only stretches of words that
templates have are streamed, for all others end matches. Every place of a stretch in a template counts. Of each template,
matches that go on neither in text nor template are chained, in the order of both, so that the words covered are
most; a chain becomes a span if it covers enough of the template, and each deciding phrase of the
template (its version, its conditions) lies whole in one match. So another version of a licence is no near miss of it.
The automaton is a few thousand words at most and goes to the tasks in their closure; documents are not shuffled.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows each get their own result.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, small_batches

#: Phrases and the label each gives wherever its words stand one after the other.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_FREE_TERMS = "is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {version} of the license or at your option any later version"
_NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details"
#: Fixed values: (label, name, version as words) of the licences of the Free Software Foundation.
_FREE = (("gpl-2", "gnu general public license", "2"), ("gpl-3", "gnu general public license", "3"), ("lgpl-2.1", "gnu lesser general public license", "2 1"), ("lgpl-3", "gnu lesser general public license", "3"), ("agpl-3", "gnu affero general public license", "3"))
#: Fixed values: (label, short form, long form) of the Creative Commons licences.
_COMMONS = (("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution sharealike"), ("cc-by-nd", "by nd", "attribution noderivatives"), ("cc-by-nc", "by nc", "attribution noncommercial"), ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"), ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"))
#: Fixed values: (label, words, deciding phrases) of licence lines and notices; the words of a deciding phrase must all match together.
TEMPLATES = (
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("granted free of charge", "sublicense and or sell copies")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("source and binary forms",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license version 2 0",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    *((label, f"licensed under the {name} version {version}", (f"{name} version {version}",)) for label, name, version in _FREE),
    *((label, f"this program {_FREE_TERMS} this program {_NO_WARRANTY}".format(name=name, version=version), (f"the {name} as published", f"version {version} of the license")) for label, name, version in _FREE),
    *((label, f"it under the terms of the {name} as published by the free software foundation either version {version} of the license or at your option any later version", (f"the {name} as published", f"version {version} of the license")) for label, name, version in _FREE),
    *((label, f"licensed under cc {short} 4 0", (f"cc {short} 4 0",)) for label, short, _ in _COMMONS),
    *((label, f"licensed under a creative commons {long} 4 0 international license", (f"commons {long} 4 0",)) for label, _, long in _COMMONS),
)


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences; for each state all places where it ends in each template."""

    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.link.append(0)
        self.length.append(length)
        self.step.append(step)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of p's longest string followed by word, apart from the longer strings of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.step[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[int], template: int) -> None:
        last = 0
        for at, word in enumerate(words):
            if word in self.step[last]:
                last = self._split(last, word, self.step[last][word])
            else:
                new, p = self._state(self.length[last] + 1, {}), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                self.link[new] = self._split(p, word, self.step[p][word]) if p >= 0 else 0
                last = new
            self.ends[last].add((template, at + 1))

    def close(self) -> None:
        """Hands the ends of each state on to the states of its suffixes."""
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def places(self, state: int, length: int, shortest: int) -> Iterator[tuple[int, int, int]]:
        """(template, end in it, words) of all stretches of some length that end with a match and aren't longer there."""
        seen: set[tuple[int, int]] = set()
        while state and length >= shortest:
            for place in self.ends[state] - seen:
                yield *place, length
            seen |= self.ends[state]
            state = self.link[state]
            length = self.length[state]

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.step[state]:
                state, length = self.step[state][word], length + 1
            out.append((state, length))
        return out


class Scanner:
    """Finds base phrases and covered template spans in one text after the other."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, min_match: int = 3, max_gap: int = 8, min_cover: float = 0.8):
        self.word_ids: dict[bytes, int] = {}
        self.labels = [label for _, label in phrases] + [label for label, *_ in templates]
        self.n_phrases = len(phrases)
        self.words = [self._numbers(t) for t in [*(p for p, _ in phrases), *(t for _, t, _ in templates)]]
        self.sizes = [len(s) for s in self.words]
        self.automaton = Automaton()
        for i, s in enumerate(self.words):
            self.automaton.add(s, i)
        # phrases that end with the strings of a state: its own and those of its suffixes
        self.done = [[t for t, end in e if t < self.n_phrases and end == self.sizes[t]] for e in self.automaton.ends]
        for state in sorted(range(1, len(self.done)), key=self.automaton.length.__getitem__):
            self.done[state] = sorted({*self.done[state], *self.done[self.automaton.link[state]]})
        self.automaton.close()
        self.deciding = [[] for _ in phrases] + [self._where(p, t + self.n_phrases) for t, (*_, p) in enumerate(templates)]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.shortest = min(self.sizes[: self.n_phrases] + [min_match])

    def _numbers(self, text: str) -> list[int]:
        return [self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in alnum_words(text)]

    def _where(self, phrases: tuple[str, ...], template: int) -> list[tuple[int, int]]:
        """First place [start, end) of each deciding phrase in its template."""
        words, out = self.words[template], []
        for p in map(self._numbers, phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            out.append((at, at + len(p)))
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """(words, (start, phrase) of base phrases, (label, first word, end, share of the template) of covered spans)."""
        words = alnum_words(text)
        ids = np.fromiter(map(self.word_ids.get, words, repeat(0)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        base: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}  # by template: first word, end, end in the template
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            known = [*ids[a:b].tolist(), 0]
            for i, (state, length) in enumerate(self.automaton.statistics(known[:-1])):
                if length < self.shortest:
                    continue
                base += [(a + i + 1 - self.sizes[p], p) for p in self.done[state] if length >= self.sizes[p]]
                for t, end, n in self.automaton.places(state, length, self.min_match):
                    if t >= self.n_phrases and (end == self.sizes[t] or known[i + 1] != self.words[t][end]):
                        matches.setdefault(t, []).append((a + i + 1 - n, a + i + 1, end))
        return len(words), sorted(base), sorted(s for t, m in matches.items() for s in self.chain(t, m))

    def chain(self, t: int, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of one template: chains that cover most words first, none over another.

        A match follows another if it begins and ends later in both text and template and begins at most ``max_gap`` words
        after it in the text; only such neighbours are looked at.
        """
        matches = sorted(matches, key=lambda m: (m[1], m[0], m[2]))
        best, before, near = [], [], 0
        for j, (a, b, end) in enumerate(matches):
            best.append(b - a)
            before.append(-1)
            while matches[near][1] < a - self.max_gap:
                near += 1
            for i in range(near, j):
                a_, b_, end_ = matches[i]
                gain = min(b - max(a, b_), end - max(end - (b - a), end_))
                if a_ < a and b_ < b and end_ - (b_ - a_) < end - (b - a) and gain > 0 and best[i] + gain > best[j]:
                    best[j], before[j] = best[i] + gain, i
        out: list[tuple[str, int, int, float]] = []
        starts: list[int] = []  # of the spans taken, which don't overlap, with their ends
        stops: list[int] = []
        for j in sorted(range(len(matches)), key=lambda j: (-best[j], j)):
            if best[j] < self.min_cover * self.sizes[t]:
                break
            links, k = [], j
            while k >= 0:
                links.append(matches[k])
                k = before[k]
            first, stop = links[-1][0], matches[j][1]
            decided = all(any(end - (b - a) <= p and q <= end for a, b, end in links) for p, q in self.deciding[t])
            at = bisect(starts, first)
            if decided and (at == 0 or stops[at - 1] <= first) and (at == len(starts) or stop <= starts[at]):
                starts.insert(at, first)
                stops.insert(at, stop)
                out.append((self.labels[t], first, stop, best[j] / self.sizes[t]))
        return out


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each whole text."""
    small_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,a:int,b:int,share:double>>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = []
            for t in some["_text"]:
                n, base, spans = scanner.scan(t)
                own = {scanner.labels[p] for _, p in base}
                starts = [a for a, _ in base] or [None]
                score = 1.0 if base else max((share for *_, share in spans), default=0.0)
                rows.append((n, len(base), starts[0], starts[-1], ",".join(sorted(own)), ",".join(sorted({*own, *(s[0] for s in spans)})), min(1.0, score), [dict(zip("label a b share".split(), s, strict=True)) for s in spans]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, key, some[key].to_numpy())
            yield out

    return docs.select(key, F.col(text).alias("_text")).mapInPandas(scan, schema)
