"""Segments against brute force; the classifier on made rows that it wasn't taught."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from folioscope.llm import toxicity
from tests.llm.test_tokens import ROWS, frame


def brute(scores):
    """Maximal segments by definition: the best segment (shortest, leftmost), then the same to its left and right."""
    if not any(s > 0 for s in scores):
        return []
    n = len(scores)
    total, a, b = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(n) for j in range(i + 1, n + 1)))[0], None, None
    for i in range(n):
        for j in range(i + 1, n + 1):
            if sum(scores[i:j]) == total and (a is None or j - i < b - a):
                a, b = i, j
    return [*brute(scores[:a]), (a, b, total), *((x + b, y + b, s) for x, y, s in brute(scores[b:]))]


def test_segments():
    r = random.Random(2)
    for _ in range(300):
        scores = [r.choice([-7, -3, -2, -1, 1, 2, 3, 5]) + r.random() / 1000 for _ in range(r.randrange(0, 14))]
        got, want = toxicity.segments(scores), brute(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_decay_solves_its_equation():
    v, p = np.array([2.0, -1.0]), np.array([0.2, 0.8])
    x = toxicity.decay(v, p)
    assert abs((p * np.exp(x * v)).sum() - 1) < 1e-6


def made(n=900):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(10, 200))]
        toxic = i % 8 == 0
        for _ in range(r.randrange(2, 6) * toxic):
            words.insert(r.randrange(len(words)), r.choice(["vile", "Nasty", "foul"]))
        rows.append((i, " ".join(words), "en", i))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = made()
    docs = frame(spark, [*rows, *((10_000 + i, *x[1:]) for i, x in enumerate(ROWS)), rows[0]])
    told = spark.createDataFrame([*labels, (None, 1), (5, None), (8, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, told)
    got = {r.doc_id: r for r in toxicity.scored(docs, model, spans=True).withColumn("h", toxicity.held_out()).collect()}
    assert len(got) == len(rows) + len(ROWS)
    for i, y in labels:
        assert got[i].h == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].predicted, y) for i, y in labels if got[i].h]
    assert sum(p == y for p, y in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(len(r.passages) == r.n_passages for r in got.values()) and got[8].n_passages > 0
    assert got[10_000].predicted == 0


def test_no_labels_and_no_rows(spark):
    docs, none = frame(spark, ROWS), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "x", 5, "s")], "doc_id long, text string, score int, predicted string")
    got = toxicity.scored(rows, toxicity.Model()).first()
    assert 0 <= got.score <= 1 and got.predicted == 0
    odd = spark.createDataFrame([(1, "vile", 5, "s", "t", 2)], "doc_id long, text string, Score int, `a``b` string, _text string, c0 int")
    got = toxicity.scored(odd, toxicity.Model({"vile": 6.0}, slope=2.0))
    assert got.columns == ["doc_id", "text", "a`b", "_text", "c0", "score", "predicted", "n_passages"]
    assert tuple(got.first())[:5] == (1, "vile", "s", "t", 2)


def brute_model(rows, folds=toxicity.FOLDS):
    """The score's definition over (text, label, fold), in plain Python."""
    words = lambda t: re.findall(r"\w+", t.lower())

    def weights(rows):
        n = [sum(y == k for _, y, _ in rows) for k in (0, 1)]
        have = [Counter(w for t, y, _ in rows if y == k for w in set(words(t))) for k in (0, 1)]
        out = {}
        for w in have[0] | have[1]:
            c, t = have[0][w], have[1][w]
            p = (t + c) / sum(n)
            cell = lambda k, m, q: k * math.log(k / (m * q)) if k else 0.0
            g = 2 * (cell(t, n[1], p) + cell(n[1] - t, n[1], 1 - p) + cell(c, n[0], p) + cell(n[0] - c, n[0], 1 - p))
            if t + c >= toxicity.LEAST_DOCUMENTS and g > toxicity.SURE**2:
                a = toxicity.PRIOR * p
                odds = [math.log((y + a) / (m + toxicity.PRIOR - y - a)) for y, m in ((t, n[1]), (c, n[0]))]
                out[w] = (odds[0] - odds[1]) * (1 - toxicity.SURE**2 / g)
        return out

    def scores(t, weights):
        return [s for *_, s in brute([weights.get(w, 0.0) - toxicity.DRIFT for w in words(t)])]

    by = [weights([r for r in rows if r[2] != f]) for f in range(folds)]
    found = [(y, len(words(t)), scores(t, by[f])) for t, y, f in rows]
    every, clean = weights(rows), [s for y, _, x in found if not y for s in x]
    tokens = Counter(w for t, y, _ in rows if not y for w in words(t))
    shares = {w: tokens[w] / sum(tokens.values()) for w in every}
    root = toxicity.decay(np.array([*(x - toxicity.DRIFT for x in every.values()), -toxicity.DRIFT]), np.array([*shares.values(), 1 - sum(shares.values())]))
    rate, frequency = (len(clean) + 1) / (sum(clean) + 1 / root), (len(clean) + 0.5) / sum(n for y, n, _ in found if not y)
    statistic = lambda s, n: math.log1p(sum(max(0, rate * x - math.log(frequency * n)) for x in s))
    slope, base = toxicity.logistic(np.array([statistic(x, n) for _, n, x in found]), np.array([float(y) for y, *_ in found]))
    return lambda t: 1 / (1 + math.exp(-base - slope * statistic(scores(t, every), len(words(t)))))


def test_score_is_the_definition(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcd") for _ in range(2)) for _ in range(12)]
    rows = []
    for i in range(240):
        words = [r.choice(vocabulary) for _ in range(r.randrange(3, 14))]
        if i % 4 == 0 or r.random() < 0.03:
            words.insert(r.randrange(len(words)), r.choice(["vile", "foul"]))
        if i % 4:
            words.append("kind")
        rows.append((i, " ".join(words), "en", i))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    taught = [(x.text, x.y, x.fold) for x in toxicity.taught_rows(docs, labels).collect()]
    want = brute_model(taught)
    model = toxicity.fit(docs, labels)
    assert any(x < 0 for x in model.weights.values()) and any(x > 0 for x in model.weights.values())
    for x in toxicity.scored(docs, model).collect():
        assert math.isclose(x.score, want(x.text), rel_tol=1e-6, abs_tol=1e-9)


def test_very_long_text(spark):
    docs = frame(spark, [(1, "kind words " * 200_000 + "vile", None, None), (2, "x" * 1_000_000, None, None)])
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.Model({"vile": 9.0, "kind": -1.0}, rate=1.0, frequency=1e-6, slope=2.0), spans=True).collect()}
    assert [p.first for p in got[1].passages] == [400_000] and got[2].passages == []
