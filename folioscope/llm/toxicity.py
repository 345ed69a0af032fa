"""Toxic passages: maximal-scoring segments over token log-odds, with extreme-value calibration.

Words get log-odds between toxic and other documents under a Dirichlet prior taken from all of them, shrunk by how likely chance is;
those of either sign count, and a drift makes words that say nothing end segments. A linear-time scan finds all maximal-scoring segments of
a text. In clean text their scores fall off exponentially; rate and frequency come from documents that a model wasn't counted on, so that
a segment of score s among n words has an expected number of frequency * n * exp(-rate * s) chance segments as good. A text's statistic sums,
over its segments, how far that lies below one, in logarithms; a logistic curve makes it a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from folioscope.llm.common import forget, table, text_or_empty, with_added, written

#: Labelled rows that the model is fitted on at most: those of smallest hash of doc_id.
FIT_ROWS = 20_000
#: Parts of them: each is scored by a model of the others, which calibrates the model of all.
FOLDS = 4
# The next four are chosen by toxicity_choice.py on rows that may teach.
#: Strength of the prior, in documents.
PRIOR = 5.0
#: Log-odds are shrunk by 1 - SURE ** 2 / G, where G is twice the logarithm of the likelihood ratio against chance, and are 0 where G is less.
SURE = 4.0
#: What every word loses, so that segments end.
DRIFT = 1.0
#: The least number of documents with a word.
LEAST_DOCUMENTS = 2
THRESHOLD = 0.3
_words = re.compile(r"\w+").findall


def held_out(doc_id="doc_id"):
    """The rows that never teach: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), left to right, in linear time (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, index of the last one with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before, total = i, total, total + s
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                found.append((start, i + 1, before, total, k))
                break
            start, before = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, y - x) for a, b, x, y, _ in found]


@dataclass
class Model:
    """Shrunk log-odds by word, without the drift, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    frequency: float = 0.1
    slope: float = 0.0
    base: float = -4.0

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal-scoring segments (first word, end word, score) and the number of words."""
        words = _words(text.lower())
        if not self.weights or self.weights.keys().isdisjoint(words):
            return [], len(words)
        get, drift = self.weights.get, self.drift
        return segments([get(w, 0.0) - drift for w in words]), len(words)

    def expected(self, score: float, n: int) -> float:
        """Chance segments as good among n words of clean text."""
        return self.frequency * n * math.exp(-min(700.0, self.rate * score))

    def statistic(self, scores: list[float], n: int) -> float:
        room = math.log(max(self.frequency * n, 1e-9))
        return math.log1p(sum(max(0.0, self.rate * s - room) for s in scores))

    def probability(self, statistic: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.base + self.slope * statistic))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float = PRIOR, sure: float = SURE) -> np.ndarray:
    """Shrunk log-odds of words in toxic and clean documents, of n_toxic and n_clean, with a Dirichlet prior in proportion to all."""
    share = (toxic + clean) / (n_toxic + n_clean)
    alpha = share * prior
    odds = lambda y, of: np.log((y + alpha) / np.maximum(1e-9, of + prior - y - alpha))
    part = lambda k, of, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / (of * p)), 0.0)
    rest = np.maximum(1.0 - share, 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (part(toxic, n_toxic, share) + part(n_toxic - toxic, n_toxic, rest) + part(clean, n_clean, share) + part(n_clean - clean, n_clean, rest))
        return np.where(g > sure**2, (odds(toxic, n_toxic) - odds(clean, n_clean)) * (1 - sure**2 / g), 0.0)


def decay(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * value)) = 1: the rate at which chance segments get rarer."""
    if not (values > 0).any() or (values * shares).sum() >= 0:
        return 1.0
    total = lambda x: float(np.sum(shares * np.exp(np.minimum(700, x * values)))) - 1
    low, high = 1e-6, 1.0
    while total(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not below 0) and intercept by Newton's method."""
    w = np.zeros(2)
    z = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def taught_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(y, fold, text) of at most rows labelled documents that aren't held out: 1 if one label of the doc_id says toxic, 0 otherwise.

    Null labels and ids teach nothing; of documents that share an id the smallest text counts.
    """
    taught = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("y"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most rows small rows: a broadcast of bounded size, so that the texts aren't shuffled before they are few.
    some = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taught), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return some.select("y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def _counted(some: DataFrame) -> DataFrame:
    """By word (null: all documents) and for each fold the toxic and clean documents with it (t0.., c0..) and its occurrences in clean ones (k0..)."""
    names = [f"{x}{f}" for x in "tck" for f in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, tokens = ([Counter() for _ in range(FOLDS)] for _ in range(3))
        for batch in batches:
            for y, fold, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(t.lower())
                (toxic if y else clean)[fold].update(set(words))
                (toxic if y else clean)[fold][None] += 1
                if not y:
                    tokens[fold].update(words)
                    tokens[fold][None] += len(words)
        every = [*set().union(*toxic, *clean)]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([x[w] for w in every], pa.int64()) for x in (*toxic, *clean, *tokens))], ["word", *names])

    return some.mapInArrow(count, ", ".join(["word string", *(f"{n} long" for n in names)])).groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, prior: float = PRIOR, sure: float = SURE, drift: float = DRIFT, least: int = LEAST_DOCUMENTS) -> Model:
    """A model of at most rows labelled documents that aren't held out (taught_rows).

    Without toxic or without other rows the model knows no word and gives every text its base rate. What reaches the driver are the words whose
    log-odds aren't 0, sums, and two numbers for each of these rows.
    """
    some = written(taught_rows(docs, labels, rows), "taught")
    counts = written(_counted(some), "counts")
    all_of = counts.where("word is null").first()
    model, folds = Model(drift=drift), range(FOLDS)
    if all_of is None or not sum(all_of[f"t{f}"] for f in folds) or not sum(all_of[f"c{f}"] for f in folds):
        toxic = all_of is not None and sum(all_of[f"t{f}"] for f in folds) > 0
        model.base = 4.0 if toxic else -4.0
        return model
    without = [[g for g in folds if g != f] for f in folds] + [list(folds)]
    sizes = [tuple(float(sum(all_of[f"{x}{g}"] for g in of)) for x in "tc") for of in without]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean, tokens = (np.stack([c.to_numpy() for c in batch.columns[1 + k * FOLDS : 1 + (k + 1) * FOLDS]]).astype(float) for k in range(3))
            found = []
            for of, (n_toxic, n_clean) in zip(without, sizes, strict=True):
                t, c, w = toxic[of].sum(0), clean[of].sum(0), np.zeros(batch.num_rows)
                often = (t + c >= least) & (n_toxic > 0) & (n_clean > 0)
                w[often] = log_odds(t[often], c[often], n_toxic, n_clean, prior, sure) if often.any() else 0.0
                found.append(w)
            some = np.flatnonzero(np.any(found, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(tokens.sum(0)[some].astype(np.int64)), *(pa.array(w[some]) for w in found)], ["word", "tokens", *(f"w{k}" for k in range(len(without)))])

    known = counts.where("word is not null").mapInArrow(weigh, ", ".join(["word string", "tokens long", *(f"w{k} double" for k in range(len(without)))])).orderBy("word").toArrow()
    words, tokens = known.column("word").to_pylist(), known.column("tokens").to_numpy()
    weights = [known.column(f"w{k}").to_numpy() for k in range(len(without))]
    models = [{w: x for w, x in zip(words, v.tolist(), strict=True) if x} for v in weights]
    model.weights = models[-1]
    if not model.weights:
        y = [sum(all_of[f"{x}{f}"] for f in folds) for x in "tc"]
        model.base = math.log(y[0] / y[1])
        return model
    shares = tokens / max(1, sum(all_of[f"k{f}"] for f in folds))
    chance = decay(np.append(weights[-1] - drift, -drift), np.append(shares, max(0.0, 1 - shares.sum())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = [Model(w, drift) for w in models[:-1]]
        for batch in batches:
            got = [by_fold[f].segments(t) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([[s for *_, s in found] for found, _ in got], pa.list_(pa.float64()))], ["y", "n", "scores"])

    measured = written(some.mapInArrow(measure, "y int, n long, scores array<double>"), "measured")
    # The scores of clean documents' segments, as exponential; the root for independent words counts as one more of them.
    clean = measured.where("y = 0").agg(F.sum(F.size("scores")), F.sum(F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)), F.sum("n")).first()
    segments_of, score, space = (x or 0 for x in clean)
    model.rate = (segments_of + 1) / (score + 1 / chance)
    model.frequency = (segments_of + 0.5) / max(1, space)
    room = F.log(F.greatest(F.lit(model.frequency) * F.col("n"), F.lit(1e-9)))
    x = F.log1p(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), F.lit(model.rate) * s - room)))
    got = measured.select(x.alias("x"), F.col("y").cast("double").alias("y")).toArrow()
    x, y = got.column("x").to_numpy(), got.column("y").to_numpy()
    # In one order, so that sums are the same however rows were dealt.
    order = np.lexsort((y, x))
    model.slope, model.base = logistic(x[order], y[order])
    forget(some, counts, measured)
    return model


PASSAGES = ArrayType(StructType([StructField("first", LongType()), StructField("end", LongType()), StructField("expected", DoubleType())]))


def scored(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """All columns of docs with score, predicted, n_passages (segments with less than one chance segment as good) and, if spans, passages (first and end
    word, chance segments as good). Null and empty texts score as texts without segments. Columns named like these, whatever their case, are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        m, out = shared.value, []
        for t in texts:
            found, n = m.segments(t.as_py())
            p = m.probability(m.statistic([s for *_, s in found], n))
            sure = [{"first": a, "end": b, "expected": e} for a, b, s in found if (e := m.expected(s, n)) < 1]
            out.append((p, int(p >= THRESHOLD), len(sure), sure)[: 3 + spans])
        kinds = [pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))][: 3 + spans]
        return [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)]

    new = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("n_passages", LongType()), StructField("passages", PASSAGES)][: 3 + spans]
    return with_added(docs, "text", new, compute)


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_passages")


QUERIES = {"op1_toxic_segments": op1_toxic_segments}
