"""The Kneser-Ney model against a direct computation; rejection on made rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import quality
from tests.llm.test_tokens import ROWS, frame


class Direct:
    """The same model from the definition."""

    def __init__(self, texts):
        n = quality.ORDER
        raw = Counter()
        for t in texts:
            for w in t.split():
                s = quality.symbols(w)
                for i in range(1, len(s)):
                    raw[tuple(s[max(0, i - n + 1) : i + 1])] += 1
        self.c = {n: {g: c for g, c in raw.items() if len(g) == n}}
        for o in range(n - 1, 0, -1):
            self.c[o] = Counter({g: c for g, c in raw.items() if len(g) == o})
            for g in self.c[o + 1]:
                self.c[o][g[1:]] += 1
        self.d, self.after = {}, {}
        for o, t in self.c.items():
            of = Counter(t.values())
            self.d[o] = quality.discounts([of[k] for k in (1, 2, 3, 4)])
            self.after[o] = defaultdict(list)
            for g, c in t.items():
                self.after[o][g[:-1]].append(c)

    def p(self, g):
        if not g:
            return quality.UNIFORM
        o = len(g)
        cut = lambda c: self.d[o][min(c, 3) - 1] if c else 0
        seen = self.after[o].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        c = self.c[o].get(g, 0)
        return max(0, c - cut(c)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * self.p(g[1:])

    def perplexity(self, text):
        logs = []
        for w in text.split():
            s = quality.symbols(w)
            logs += [math.log(self.p(tuple(s[max(0, i - quality.ORDER + 1) : i + 1]))) for i in range(1, len(s))]
        return math.exp(-sum(logs) / len(logs)) if logs else None


def made():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(r.randrange(1, 5)))
    good = [(i, " ".join(word() for _ in range(r.randrange(5, 80))), "en", i) for i in range(120)]
    bad = [(500 + i, " ".join(word().upper() + "&&&" for _ in range(30)), "en", i) for i in range(5)]
    return good, bad


@pytest.mark.parametrize("entries", [quality.BROADCAST_ENTRIES, 0])
def test_perplexity_is_the_definition(spark, entries):
    good, bad = made()
    good[7] = (7, "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8 \u0f40\u0f41 \U0001f600 \u65e5", "ja", 7)
    trusted = frame(spark, good[:80])
    docs = frame(spark, [*good, *bad, *ROWS, good[0]])
    tables = quality.model_tables(quality.counted(trusted))
    direct = Direct([t for _, t, *_ in good[:80]])
    got = quality.with_perplexity(docs, tables, quality.shared_model(tables, entries)).collect()
    assert len(got) == len(good) + len(bad) + len(ROWS) + 1
    for r in got:
        want = direct.perplexity(r.text or "")
        assert (want is None and r.perplexity is None) or math.isclose(r.perplexity, want, rel_tol=1e-9), r


def test_probabilities_sum_to_one():
    d = Direct(["the then there", "on an ring", "reing thing"])
    every = range(1 << quality.BITS)
    for context in [(), (1,), (1, ord("t")), tuple(map(ord, "ther"))[:4], (9, 9)]:
        assert math.isclose(sum(d.p((*context, c)) for c in every), 1.0, rel_tol=1e-9)


def test_rejection(spark):
    good, bad = made()
    docs = frame(spark, [*good, *bad, (900, None, None, None), (901, " ", "xx", None), (902, good[3][1], None, 0), (903, bad[0][1], "xx", 0)])
    labels = spark.createDataFrame([*((i, 1) for i in range(80)), (500, 0), (500, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r.rejected for r in quality.judged(docs, quality.trusted_of(docs, labels), 1.0).collect()}
    assert not any(got[i] for i in range(80)) and all(got[500 + i] for i in range(5))
    assert got[900] and got[901] and not got[902] and got[903]
    assert sum(got[i] for i in range(80, 120)) <= 4


def test_limits_of_languages_with_few_held_out_documents(spark):
    r = random.Random(4)
    draw = lambda mean: math.exp(r.gauss(mean, 0.2))
    few = [(f"l{k}", 3 + k % 5 / 2, 1 + k % 7) for k in range(300)]
    rows = [("many", draw(3)) for _ in range(2000)] + [(None, draw(4)) for _ in range(3)] + [("none", None)] + [(name, draw(mean)) for name, mean, n in few for _ in range(n)]
    known = spark.createDataFrame(rows, "lang string, perplexity double")
    most = {name: max(p for lang, p in rows if lang == name) for name, *_ in few}
    def limits_of(rows):
        limits, general = quality.language_limits(rows)
        return {r.lang: r.limit for r in limits.collect()}, general

    limits, general = limits_of(known)
    assert "none" not in limits and None in limits
    assert limits["many"] == known.where("lang = 'many'").selectExpr("percentile_approx(perplexity, 0.995, 10000)").first()[0]
    new = [(name, draw(mean)) for name, mean, _ in few for _ in range(20)]
    # By the maximum of a language's few documents, which their quantile is, many good ones are lost.
    assert sum(p > most[name] for name, p in new) > 0.2 * len(new)
    assert sum(p > limits[name] for name, p in new) < 0.02 * len(new)
    # What is far from a language is still rejected.
    assert sum(math.exp(mean + 2) > limits[name] for name, mean, _ in few) == len(few)
    alone = spark.createDataFrame([("a", 5.0), ("b", 9.0)], "lang string, perplexity double")
    assert limits_of(alone) == ({"a": 9.0, "b": 9.0}, 9.0)
    assert limits_of(alone.limit(0)) == ({}, None)


@pytest.mark.parametrize("entries", [quality.BROADCAST_ENTRIES, 0])
def test_clashing_names(spark, entries):
    rows = [(i, t, "en", "x", 1.0, "y", True) for i, t, *_ in made()[0][:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, Perplexity double, `a``b` string, LIMIT boolean")
    got = quality.judged(docs, docs, 1.0, entries)
    assert got.columns == ["doc_id", "text", "lang", "_text", "a`b", "perplexity", "limit", "rejected"]
    assert {(r._text, r["a`b"]) for r in got.collect()} == {("x", "y")}


def test_no_two_characters_share_symbols():
    every = [chr(c) for c in range(3, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert len({tuple(quality.symbols(c)) for c in every}) == len(every) and max(max(quality.symbols(c)) for c in every) < 1 << quality.BITS


def test_nothing_trusted_and_no_rows(spark):
    docs = frame(spark, ROWS)
    assert {bool(r.text and r.text.strip()) == (not r.rejected) for r in quality.judged(docs, docs.limit(0)).collect()} == {True}
    assert quality.judged(docs.limit(0), docs.limit(0)).count() == 0


@pytest.mark.parametrize("characters, words", [(1 << 21, 100_000), (1, 1), (7, 3)])
def test_keys_of_many_words_are_those_of_each(monkeypatch, characters, words):
    monkeypatch.setattr(quality, "CHARACTERS", characters)
    monkeypatch.setattr(quality, "WORDS", words)
    texts = ["a the\x01 \x02\x00 then", "", "  ", "\U0001f600x ྠ ྟ y", "z", "longer words here and there"]
    got = [(i, quality.keys_of([p]).tolist()) for places, pieces in quality.portions(texts) for i, p in zip(places, pieces, strict=True)]
    whole = [k for _, pieces in quality.portions(texts) for k in quality.keys_of(pieces).tolist()]
    want = [[g for w in t.split() for g in quality.grams(w)] for t in texts]
    for i, w in enumerate(want):
        assert [k for j, ks in got if j == i for k in ks] == [k for _, k in w]
    assert whole == [k for w in want for _, k in w]
    assert quality.order_of(np.array(whole)).tolist() == [o for w in want for o, _ in w]
