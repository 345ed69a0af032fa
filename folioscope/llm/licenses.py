"""Licence scans: template markup compiled to token automata that accept a wording only if its mandatory words match exactly.

Markup: <<beginOptional>> ... <<endOptional>> may be absent (and may be nested); <<var;name="n";words="a-b">> stands for a to b
arbitrary words; <<oneOf;name="n";words="x y|z">> for one of the listed wordings. Everything else is mandatory, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table, text_or_empty

#: A to Z count as a to z; any other character from U+0080 on belongs to a word. In UTF-8 that can be told by the byte.
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _word.findall(text.encode("utf-8", "replace").lower())


#: Wordings whose places make up the base labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_HOLDER = '<<var;name="holder";words="0-12">>'
_ASIS = 'the software is provided "as is"'

# Fixed wordings of public licences, with the markup above. Several wordings may share a label.
TEMPLATES: list[tuple[str, str]] = [
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<oneOf;name="what";words="this software and associated documentation files|this software">>
        <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3-clause",
        f"""Neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;name="what";words="1-3">> except in compliance with the License.""",
    ),
    (
        "apache-2.0",
        """<<beginOptional>>This work is<<endOptional>> <<oneOf;name="verb";words="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>>
        Apache <<oneOf;name="form";words="license|software license">> <<beginOptional>>version<<endOptional>> 2.0""",
    ),
    (
        "mit",
        """<<beginOptional>>This work is<<endOptional>> <<oneOf;name="verb";words="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>>
        <<oneOf;name="name";words="mit|expat|mit expat|mit x11">> <<oneOf;name="form";words="license|licence">>""",
    ),
    (
        "gpl-2.0-or-later",
        """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version""",
    ),
    (
        "gpl-3.0-or-later",
        """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version""",
    ),
    (
        "lgpl-2.1-or-later",
        """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
        License, or (at your option) any later version""",
    ),
    *(
        (
            f"{short}-{n}.0",
            f"""<<oneOf;name="verb";words="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>>
            <<beginOptional>>GNU<<endOptional>> {long} <<oneOf;name="form";words="license|licence">> <<oneOf;name="v";words="version|v">> {n}""",
        )
        for short, long in (("gpl", "General Public"), ("agpl", "Affero General Public"))
        for n in (2, 3)
    ),
    *((f"gpl-{n}.0", f'<<oneOf;name="verb";words="licensed|released|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> <<oneOf;name="short";words="gnu gpl|gpl">> <<oneOf;name="v";words="v{n}|version {n}|{n}">>') for n in (2, 3)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *(
        (
            f"cc-{kind}-{version}",
            f"""<<oneOf;name="verb";words="licensed|released|distributed|available">> under <<oneOf;name="article";words="cc|a cc|the cc">> {kind} {version}""",
        )
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
        for version in ("3.0", "4.0")
    ),
    *(
        (f"cc-{kind}", f"""under a Creative Commons {long} <<beginOptional>>{v}<<endOptional>> <<beginOptional>>International<<endOptional>> License""")
        for v in ("4.0",)
        for kind, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"))
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("spdx-id", 'SPDX-License-Identifier: <<var;name="identifier";words="1-1">>'),
    ("as-is-disclaimer", f'{_ASIS}<<beginOptional>>,<<endOptional>> without warranty of any kind, <<oneOf;name="e";words="express or implied|expressed or implied|either express or implied">>'),
]

_markup = re.compile(r'<<(beginOptional|endOptional|var|oneOf)((?:;\w+="[^"]*")*)>>')


def _parse(template: str) -> list:
    """Nested list: words (bytes), ("optional", list), ("any", least, most), ("one", [word lists])."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_markup.finditer(template), None]:
        stack[-1] += words_of(template[at : m.start() if m else None])
        if m is None:
            break
        at = m.end()
        values = dict(re.findall(r';(\w+)="([^"]*)"', m[2]))
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without its begin")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif m[1] == "var":
            least, most = map(int, values["words"].split("-"))
            if not 0 <= least <= most:
                raise ValueError("a variable needs a range of words")
            stack[-1].append(("any", least, most))
        else:
            stack[-1].append(("one", [words_of(x) for x in values["words"].split("|")]))
    if len(stack) > 1:
        raise ValueError("an optional region isn't closed")
    return stack[0]


@dataclass(frozen=True)
class Match:
    label: str
    start: int
    end: int
    mandatory: int


class Automaton:
    """One template over words. Subsets of its places are made into states when a text first needs them."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.on: list[dict[bytes, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.alphabet: set[bytes] = set()
        self.mandatory: set[bytes] = set()
        parsed = _parse(template)
        self.mandatory = {x for x in parsed if isinstance(x, bytes)}
        self.n_mandatory = sum(isinstance(x, bytes) for x in parsed)
        if not self.n_mandatory:
            raise ValueError("a template needs a mandatory word")
        self.accept = self._sequence(0, parsed)
        start = self._closure({0})
        if self.accept in start:
            raise ValueError("a template must not accept nothing")
        self.subsets, self.ids, self.step = [start], {start: 0}, {}
        self.starts = None if any(self.any[p] for p in start) else {w for p in start for w in self.on[p]}

    def _place(self) -> int:
        self.on.append({})
        self.any.append([])
        self.empty.append([])
        return len(self.on) - 1

    def _sequence(self, at: int, items: list) -> int:
        for x in items:
            if isinstance(x, bytes):
                to = self._place()
                self.on[at].setdefault(x, []).append(to)
                self.alphabet.add(x)
            elif x[0] == "any":
                to = at
                for k in range(x[2]):
                    n = self._place()
                    self.any[to].append(n)
                    to = n
                    if k + 1 <= x[1]:
                        at = to
                end = self._place()
                # From the least number of words on, the variable may end after each.
                p = at
                self.empty[p].append(end)
                while p != to:
                    p = self.any[p][-1]
                    self.empty[p].append(end)
                to = end
            else:
                end = self._place()
                for inner in [x[1]] if x[0] == "optional" else x[1]:
                    begin = self._place()
                    self.empty[at].append(begin)
                    self.empty[self._sequence(begin, inner)].append(end)
                if x[0] == "optional":
                    self.empty[at].append(end)
                to = end
            at = to
        return at

    def _closure(self, places: set[int]) -> frozenset[int]:
        found, todo = set(places), list(places)
        while todo:
            for q in self.empty[todo.pop()]:
                if q not in found:
                    found.add(q)
                    todo.append(q)
        return frozenset(found)

    def _advance(self, state: int, word: bytes | None) -> int:
        to: set[int] = set()
        for p in self.subsets[state]:
            to.update(self.any[p])
            if word is not None:
                to.update(self.on[p].get(word, ()))
        if not to:
            return -1
        closed = self._closure(to)
        if closed not in self.ids:
            self.ids[closed] = len(self.subsets)
            self.subsets.append(closed)
        return self.ids[closed]

    def ends(self, words: list[bytes], start: int) -> int | None:
        """End of the longest wording that starts at a word, or None."""
        state, best = 0, None
        for k in range(start, len(words)):
            w = words[k] if words[k] in self.alphabet else None
            key = (state, w)
            nxt = self.step.get(key)
            if nxt is None:
                nxt = self.step[key] = self._advance(state, w)
            if nxt < 0:
                break
            state = nxt
            if self.accept in self.subsets[state]:
                best = k + 1
        return best

    def matches(self, words: list[bytes]) -> Iterator[Match]:
        """Every place at which the wording starts."""
        for i, w in enumerate(words):
            if self.starts is None or w in self.starts:
                end = self.ends(words, i)
                if end is not None:
                    yield Match(self.label, i, end, self.n_mandatory)


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [Automaton(k, v) for k, v in base.items()]
        self.own = [Automaton(k, v) for k, v in templates]

    def scan(self, words: list[bytes]) -> tuple[list[Match], list[Match]]:
        """Places of the base wordings and of the templates."""
        there = set(words)
        return [[m for a in group if a.mandatory <= there for m in a.matches(words)] for group in (self.base, self.own)]


def scanned(docs: DataFrame, templates=None, base=None) -> DataFrame:
    """Per document: words, base places and labels, all labels, places of every match, and a score.

    score is the longest matched wording's mandatory words m as m / (m + 4), 0 without a match. A null text is empty: no words, empty labels.
    """
    templates, base = templates or TEMPLATES, base or BASE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = words_of(t.as_py())
                places, own = scanner.scan(words)
                starts = [m.start for m in places]
                labels = sorted({m.label for m in places})
                both = sorted({m.label for m in [*places, *own]})
                most = max((m.mandatory for m in [*places, *own]), default=0)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(both), most / (most + 4), [{"label": m.label, "start": m.start, "end": m.end} for m in own]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:bigint,end:bigint>>")


def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("places")


QUERIES = {"op5_license_templates": op5_license_templates}
