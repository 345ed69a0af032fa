"""Licence automata against brute force."""

import itertools
import re

import pytest

from folioscope.llm import licenses
from tests.llm.test_tokens import ROWS, frame

W = licenses.words_of


def accepts(items, words):
    """All lengths that a parsed template can take from the front of words, by plain recursion."""
    if not items:
        return {0}
    x, rest = items[0], items[1:]
    if isinstance(x, bytes):
        return {1 + n for n in accepts(rest, words[1:])} if words[:1] == [x] else set()
    if x[0] == "any":
        return {k + n for k in range(x[1], min(x[2], len(words)) + 1) for n in accepts(rest, words[k:])}
    if x[0] == "optional":
        return accepts(rest, words) | accepts(x[1] + rest, words)
    return {n for one in x[1] for n in accepts(one + rest, words)}


def test_small_templates_by_brute_force():
    templates = [
        "a b",
        "a <<beginOptional>>b<<endOptional>> a",
        'a <<var;name="x";words="0-2">> b',
        '<<var;name="x";words="1-3">> b a',
        '<<beginOptional>>a <<beginOptional>>b<<endOptional>> c<<endOptional>> a',
        '<<oneOf;name="x";words="a|b c|a b">> a <<var;name="y";words="2-2">>',
    ]
    for t in templates:
        a, parsed = licenses.Automaton("x", t), licenses._parse(t)
        for n in range(6):
            for words in itertools.product([b"a", b"b", b"c"], repeat=n):
                words = list(words)
                for i in range(n):
                    assert a.ends(words, i) == max((i + n for n in accepts(parsed, words[i:])), default=None), (t, words, i)


def test_bad_markup():
    for t in ("<<beginOptional>>a", "a<<endOptional>>", '<<var;name="x";words="0-2">>', 'a <<var;name="x";words="3-2">>', ""):
        with pytest.raises(ValueError):
            licenses.Automaton("x", t)


@pytest.mark.parametrize(
    "text,base,labels",
    [
        ("Released under the MIT License.", "mit", "mit"),
        ("released under the mit-license ... UNDER\nTHE, MIT (license)", "mit", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2,apache-2.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc-by-nc,cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3.0"),
        ("Permission is hereby granted, free of charge, to any person", "", ""),
        ("SPDX-License-Identifier: BSD", "", "spdx-id"),
        ("under the mité license", "", ""),
        ("", "", ""),
    ],
)
def test_labels(text, base, labels):
    s = licenses.Scanner()
    b, own = s.scan(W(text))
    assert ",".join(sorted({m.label for m in b})) == base
    assert ",".join(sorted({m.label for m in [*b, *own]})) == labels


def test_full_texts_are_accepted_and_changes_are_not():
    mit = re.sub(r"<<oneOf[^>]*>>", "this software and associated documentation files", re.sub(r"<<(begin|end)Optional>>", "", dict(licenses.TEMPLATES)["mit-text"]))
    s = licenses.Scanner()
    assert {m.label for m in s.scan(W("x " + mit.upper() + " y"))[1]} == {"mit-text"}
    assert not s.scan(W(mit.replace("sublicense", "sub")))[1]


def test_query_rows(spark):
    rows = [*ROWS, (90, "cc by nc under the mit license. CC-BY-NC x", "en", 1)]
    got = {r.doc_id: r for r in licenses.scanned(frame(spark, rows)).collect() if r.doc_id is not None}
    phrases = {k: W(v) for k, v in licenses.BASE.items()}
    for d, t, *_ in rows:
        if d is None or d == 7:
            continue
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if [w.encode() for w in words[i : i + len(p)]] == p]
        r = got[d]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places})))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scanned(frame(spark, [])).count() == 0
