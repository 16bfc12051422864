"""License scan: template markup compiled to token automata, plus plain phrases.

A template is a license's wording with regions marked
``<<beginOptional>> ... <<endOptional>>`` (may be left out, may be nested) and
``<<var;min=a;max=b>>`` (any a to b words).  It becomes an automaton over words; a
text is accepted where the mandatory words stand exactly, in order, with nothing between
them but what the marked regions allow.  An automaton is only started where one of its
first words stands, in texts that hold its longest mandatory word.

Every text is scanned whole, in its task; nothing is shuffled.

Defined cases: a null text is empty and has no words, places or labels; its score is 0.
Places of overlapping phrases all count.  Ties and repeated rows get equal results;
other columns pass as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.common import columns, with_made

words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

# Fixed values of the scan's contract: phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license wordings; (label, template).
TEMPLATES = (
    ("mit-notice", "<<beginOptional>>this <<var;min=1;max=3>> is<<endOptional>> <<beginOptional>>released <<endOptional>>"
                   "<<beginOptional>>licensed <<endOptional>><<beginOptional>>distributed <<endOptional>>under the "
                   "<<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("apache-2.0-notice", "Licensed under the Apache License, <<beginOptional>>Version <<endOptional>>2.0"),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
<<var;min=1;max=4>> except in compliance with the License. You may obtain a copy of the License at <<var;min=1;max=10>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("gpl-notice", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU <<beginOptional>>Lesser "
                   "<<endOptional>>General Public License<<beginOptional>>, version <<var;min=1;max=2>><<endOptional>>"),
    ("gpl-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version <<var;min=1;max=2>> of the License, or
(at your option) any later version.<<beginOptional>> This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.<<endOptional>>"""),
    ("cc-notice", "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>"
                  "<<beginOptional>>Creative Commons <<endOptional>>CC BY<<beginOptional>> NC<<endOptional>>"
                  "<<beginOptional>> SA<<endOptional>><<beginOptional>> ND<<endOptional>> <<var;min=2;max=2>>"),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;min=2;max=8>>
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;min=3;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
)


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Automaton:
    """Nondeterministic automaton over words for one template."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.step: list[dict[str, int]] = [{}]  # word -> next state
        self.any: list[int | None] = [None]  # next state on any word
        self.skip: list[list[int]] = [[]]  # states reached without a word
        mandatory, state, opened = [], 0, []
        for part in re.split(r"(<<.*?>>)", template):
            if part.startswith("<<beginOptional"):
                opened.append(state)
            elif part.startswith("<<endOptional"):
                self.skip[opened.pop()].append(state)
            elif part.startswith("<<var"):
                given = dict(x.split("=", 1) for x in part[2:-2].split(";")[1:])
                least, most = int(given.get("min", 0)), int(given.get("max", 10))
                ends = []
                for i in range(most):
                    if i >= least:
                        ends.append(state)
                    self.any[state] = new = self._state()
                    state = new
                for e in ends:
                    self.skip[e].append(state)
            else:
                for word in words_of(lower_ascii(part)):
                    # A state of its own in front, so that a word never shares one with an any-word step.
                    before, after = self._state(), self._state()
                    self.skip[state].append(before)
                    self.step[before][word] = after
                    state = after
                    if not opened:
                        mandatory.append(word)
        if opened or not mandatory:
            raise ValueError(f"template {label}: regions must be closed and some words mandatory")
        self.final = state
        self.start = self._close({0})
        if any(self.any[s] is not None for s in self.start):
            raise ValueError(f"template {label}: it must begin with a word")
        self.first = {w for s in self.start for w in self.step[s]}
        self.must = max(mandatory, key=len)

    def _state(self) -> int:
        self.step.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[str], at: int) -> int:
        """Where the longest match that starts at word ``at`` ends, or -1."""
        states, end = self.start, -1
        for i in range(at, len(words)):
            word, reached = words[i], set()
            for s in states:
                if word in self.step[s]:
                    reached.add(self.step[s][word])
                if self.any[s] is not None:
                    reached.add(self.any[s])
            if not reached:
                break
            states = self._close(reached)
            if self.final in states:
                end = i + 1
        return end


class Scanner:
    """Phrases and automata over one text at a time."""

    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]):
        self.phrases = [(" ".join(words_of(lower_ascii(p))), label) for p, label in phrases.items()]
        self.automata = [Automaton(label, t) for label, t in templates]

    def places(self, line: str) -> list[tuple[int, str]]:
        """(start word, label) of each place of a phrase in the joined words."""
        found = []
        for phrase, label in self.phrases:
            at, seen, word = line.find(f" {phrase} "), 0, 0
            while at >= 0:
                word += line.count(" ", seen, at)  # from the last place on
                seen = at
                found.append((word, label))
                at = line.find(f" {phrase} ", at + 1)
        return found

    def matches(self, words: list[str], text: str) -> list[tuple[int, int, str]]:
        """(start, end, label) in words; matches of one template don't overlap."""
        found = []
        for a in self.automata:
            if a.must not in text:
                continue
            at = 0
            while at < len(words):
                end = a.match(words, at) if words[at] in a.first else -1
                if end > 0:
                    found.append((at, end, a.label))
                at = max(end, at + 1)
        return found

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score)."""
        low = lower_ascii(text or "")
        words = words_of(low)
        base = self.places(f" {' '.join(words)} ")
        hits = self.matches(words, low)
        covered = set()
        for start, end, _ in hits:
            covered.update(range(start, end))
        labels = {label for _, label in base}
        starts = [i for i, _ in base]
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | {label for _, _, label in hits})), len(covered) / len(words) if words else 0.0)


COLUMNS = columns(n_words=T.LongType(), n_base=T.LongType(), first_word=T.LongType(), last_word=T.LongType(),
                  base_labels=T.StringType(), labels=T.StringType(), score=T.DoubleType())
MATCHES = columns(matches=T.ArrayType(columns(start=T.LongType(), end=T.LongType(), label=T.StringType())))


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None,
         templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` without ``text``, with the columns of ``COLUMNS``: the phrase
    places, the labels and the share of words that templates cover."""
    scanner = Scanner(PHRASES if phrases is None else phrases, templates)
    return with_made(docs, text, COLUMNS,
                     lambda texts: [list(x) for x in zip(*map(scanner.scan, texts))])


def spans(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` without ``text``, with ``matches``: start word, end word and label
    of every template match."""
    scanner = Scanner({}, templates)

    def make(texts: list[str | None]) -> list[list]:
        low = [lower_ascii(t or "") for t in texts]
        return [[[dict(zip(("start", "end", "label"), m)) for m in scanner.matches(words_of(t), t)] for t in low]]

    return with_made(docs, text, MATCHES, make)
