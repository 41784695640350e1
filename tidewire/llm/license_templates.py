"""Licence wording found by templates with markup, compiled to one automaton over words.

A template is mandatory wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>``
around words that may be absent, nested at will, and ``<<var;words=2..40>>`` for a region that any
2 to 40 words may replace. All templates are compiled to one automaton whose states are sets of
places in them; its moves are worked out when a text first needs them. It starts at every word
that can begin a template and accepts where all mandatory wording has been read exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import map_batches, raw_text

# Phrases that count wherever their words stand, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence texts and notices as templates, (label, wording).
TEMPLATES = (
    ("apache-2.0-notice", "<<beginOptional>>this <<var;words=1..3>> is<<endOptional>> licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license <<beginOptional>>you may obtain a copy of the license at <<var;words=1..12>><<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of <<var;words=1..20>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0 <<beginOptional>>license<<endOptional>>"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0-notice", "<<beginOptional>>this <<var;words=1..3>> is<<endOptional>> licensed under the gnu general public license <<beginOptional>>gpl<<endOptional>> version 3 <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<var;words=1..2>> of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-notice", "<<beginOptional>>this <<var;words=1..3>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"),
)

# Words of mandatory wording at which the score is one half.
HALF = 4
# Bytes of a text that are cut into words at once.
CHUNK_BYTES = 1 << 20
# States after which the automaton forgets the moves it has worked out.
MOST_STATES = 100_000

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+))>>|([^\s<]+)")
# A-Z to a-z; every other ASCII character that is neither a digit nor a-z to a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Region:
    """``least`` to ``most`` words of any kind."""

    least: int
    most: int


@dataclass(frozen=True)
class Optional:
    parts: tuple


def parse(template: str) -> tuple:
    """A template's parts: words, Regions and Optionals. Raises ValueError on markup that is not closed."""
    levels: list[list] = [[]]
    for found in _MARKUP.finditer(template):
        mark, least, most, word = found.groups()
        if word is not None:
            levels[-1].append(word)
        elif mark == "beginOptional":
            levels.append([])
        elif mark == "endOptional":
            if len(levels) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = tuple(levels.pop())
            levels[-1].append(Optional(inner))
        elif int(least) > int(most):
            raise ValueError(f"region of {least}..{most} words")
        else:
            levels[-1].append(Region(int(least), int(most)))
    if len(levels) > 1:
        raise ValueError("beginOptional without endOptional")
    return tuple(levels[0])


def mandatory_words(parts: Sequence) -> int:
    return sum(isinstance(p, str) for p in parts)


def longest(parts: Sequence) -> int:
    """The most words that the parts can match."""
    return sum(1 if isinstance(p, str) else p.most if isinstance(p, Region) else longest(p.parts) for p in parts)


class Automaton:
    """All templates as one automaton over words (bytes), read from any start.

    A place is a number; ``words[place]`` and ``steps[place]`` are its moves on one word and on
    any word, ``free[place]`` those without a word. A state is a set of places.
    """

    def __init__(self, templates: Sequence[tuple]):
        self._word: list[tuple[bytes, int] | None] = []
        self._any: list[int | None] = []
        self._free: list[list[int]] = []
        self._accepts: dict[int, int] = {}
        heads = []
        for number, parts in enumerate(templates):
            head = self._place()
            tail = self._build(parts, head)
            self._accepts[tail] = number
            heads.append(head)
        self.span = max((longest(parts) for parts in templates), default=0)
        self._first = self._closed(heads)
        if any(self._any[place] is not None for place in self._first) or any(p in self._accepts for p in self._first):
            raise ValueError("a template has to begin with wording")
        self.starts = {self._word[place][0] for place in self._first if self._word[place]}
        self._forget()

    def _place(self) -> int:
        self._word.append(None)
        self._any.append(None)
        self._free.append([])
        return len(self._free) - 1

    def _build(self, parts: Sequence, place: int) -> int:
        for part in parts:
            if isinstance(part, Optional):
                start = self._place()
                self._free[place].append(start)
                after = self._build(part.parts, start)
                end = self._place()
                self._free[after].append(end)
                self._free[place].append(end)
                place = end
            elif isinstance(part, Region):
                end = self._place()
                for i in range(part.most):
                    if i >= part.least:
                        self._free[place].append(end)
                    after = self._place()
                    self._any[place] = after
                    place = after
                self._free[place].append(end)
                place = end
            else:
                after = self._place()
                self._word[place] = (part.encode(), after)
                place = after
        return place

    def _closed(self, places) -> frozenset:
        seen, todo = set(places), list(places)
        while todo:
            for place in self._free[todo.pop()]:
                if place not in seen:
                    seen.add(place)
                    todo.append(place)
        return frozenset(p for p in seen if self._word[p] or self._any[p] is not None or p in self._accepts)

    def _forget(self) -> None:
        self._numbers: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._moves: list[dict[bytes, int] | None] = []
        self._else: list[int] = []
        self._accepted: list[tuple[int, ...]] = []
        self._begin = self._state(self._first)

    def _state(self, places: frozenset) -> int:
        """The number of a state; -1 is the one from which nothing can be read or accepted."""
        if not places:
            return -1
        number = self._numbers.get(places)
        if number is None:
            number = self._numbers[places] = len(self._sets)
            self._sets.append(places)
            self._moves.append(None)
            self._else.append(-1)
            self._accepted.append(tuple(sorted({self._accepts[p] for p in places if p in self._accepts})))
        return number

    def _expand(self, state: int) -> dict[bytes, int]:
        """Work out where each word that the state names leads, and where all others lead."""
        places = self._sets[state]
        loose = [self._any[p] for p in places if self._any[p] is not None]
        named: dict[bytes, list[int]] = {}
        for place in places:
            if self._word[place]:
                word, after = self._word[place]
                named.setdefault(word, []).append(after)
        self._else[state] = self._state(self._closed(loose))
        moves = {word: self._state(self._closed(loose + after)) for word, after in named.items()}
        self._moves[state] = moves
        return moves

    def read(self, words: list[bytes], start: int) -> dict[int, int]:
        """Template -> end of its longest match that starts at word ``start``."""
        if len(self._sets) > MOST_STATES:
            self._forget()
        state, found = self._begin, {}
        for i in range(start, len(words)):
            moves = self._moves[state]
            if moves is None:
                moves = self._expand(state)
            state = moves.get(words[i], self._else[state])
            if state < 0:
                break
            for number in self._accepted[state]:
                found[number] = i + 1
        return found


def word_chunks(text: bytes, chunk_bytes: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists, each from about ``chunk_bytes`` bytes; a word is never cut."""
    start = 0
    while start < len(text):
        stop = min(start + chunk_bytes, len(text))
        part = text[start:stop].translate(_FOLD)
        if stop < len(text) and part[-1:] != b" ":
            cut = part.rfind(b" ")
            if cut < 0:
                # One word longer than the chunk: take the text up to its end.
                while stop < len(text) and _FOLD[text[stop]] != 32:
                    stop += 1
                part = text[start:stop].translate(_FOLD)
            else:
                stop = start + cut + 1
                part = part[: cut + 1]
        start = stop
        yield part.split()


def scan_text(automaton: Automaton, text: bytes, base: int, chunk_bytes: int = CHUNK_BYTES):
    """(number of words, [(template, start, end)]) of a whole text.

    Templates below ``base`` count at every start; of the others, matches of one template do not
    overlap, leftmost and longest first.
    """
    found: list[tuple[int, int, int]] = []
    busy: dict[int, int] = {}
    starts, span = automaton.starts, automaton.span
    kept: list[bytes] = []
    offset = done = 0

    def search(until: int) -> None:
        for i in [i for i in range(done - offset, until) if kept[i] in starts]:
            for number, end in automaton.read(kept, i).items():
                if number < base or busy.get(number, 0) <= offset + i:
                    found.append((number, offset + i, offset + end))
                    busy[number] = offset + end

    for words in word_chunks(text, chunk_bytes):
        kept = kept[done - offset :] + words
        offset = done
        until = max(len(kept) - span, 0)
        search(until)
        done = offset + until
    search(len(kept))
    return offset + len(kept), found


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, base places, labels, spans, whole, score.

    Words are runs of a-z, digits and characters beyond ASCII, after A-Z became lower case.
    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` their smallest and
    largest start. ``spans`` lists every match of a template as ``label:start:end`` (words, end
    excluded) by start, then label; ``whole`` says that one match is the whole text. ``score``
    is m / (m + 4) for the longest mandatory wording of m words that was found, 0 without any.
    NULL counts as the empty text: no words, empty labels, score 0. Repeated rows and ids each give
    their row, an empty table an empty result; long texts are read in pieces that overlap by
    the longest template. Other columns, whatever their names, are not read.
    """
    names = [*phrases.values(), *(label for label, _ in templates)]
    parsed = [*(tuple(p.split()) for p in phrases), *(parse(t) for _, t in templates)]
    weights = [mandatory_words(p) for p in parsed]
    base = len(phrases)
    rows = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    class Scan:
        @staticmethod
        def per_task():
            automaton = Automaton(parsed)

            def step(cols: dict[str, list]) -> dict[str, list]:
                out: dict[str, list] = {name: [] for name in _COLUMNS}
                for text in cols["text"]:
                    n, found = scan_text(automaton, text, base)
                    places = [start for number, start, _ in found if number < base]
                    told = sorted((start, names[number], end) for number, start, end in found if number >= base)
                    most = max((weights[number] for number, _, _ in found), default=0)
                    out["n_words"].append(n)
                    out["n_base"].append(len(places))
                    out["first_word"].append(min(places, default=None))
                    out["last_word"].append(max(places, default=None))
                    out["base_labels"].append(",".join(sorted({names[number] for number, _, _ in found if number < base})))
                    out["labels"].append(",".join(sorted({names[number] for number, _, _ in found})))
                    out["spans"].append(",".join(f"{label}:{start}:{end}" for start, label, end in told))
                    out["whole"].append(any(end - start == n for start, _, end in told))
                    out["score"].append(most / (most + HALF))
                return {"id": cols["id"], **out}

            return step

    schema = f"id {id_type}, " + ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items())
    return map_batches(rows, Scan(), schema)


_COLUMNS = {
    "n_words": "long",
    "n_base": "long",
    "first_word": "long",
    "last_word": "long",
    "base_labels": "string",
    "labels": "string",
    "spans": "string",
    "whole": "boolean",
    "score": "double",
}


def as_pattern(parts: Sequence) -> str:
    """A template as a regular expression over words that each follow one blank; for oracles."""
    made = ""
    for part in parts:
        if isinstance(part, Optional):
            made += f"(?:{as_pattern(part.parts)})?"
        elif isinstance(part, Region):
            made += f"(?: [^ ]+){{{part.least},{part.most}}}"
        else:
            made += f" {part}"
    return made
