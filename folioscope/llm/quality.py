"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams within words, trained on trusted text.

Counts, continuation counts, contexts and lower orders are tables joined on their keys, sharded by them. A document's perplexity is
that of the characters of all its words; documents above a limit from their language's held-out trusted documents are rejected.
An n-gram of up to five symbols is one integer, 12 bits a symbol. 1 starts a word (only as context) and 2 ends it; code points from WIDE on
are two symbols each, of which the first is never an end of a character below WIDE, so no two texts have the same symbols.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from folioscope.llm.common import forget, table, text_or_empty, with_added, written

ORDER, BITS = 5, 12
MASK = (1 << BITS) - 1
#: Code points below are a symbol each (0 to 2 are marks and share one); c above is WIDE + c // 1024 (below 4096) and then 3 + c % 1024.
WIDE = 3000
UNIFORM = 1.0 / (1 << BITS)
QUANTILE = 0.995
#: One in so many trusted texts, by hash, gives limits instead of counts: texts that a model was trained on have lower perplexity than others as good.
HELD_OUT = 5
#: Entries (16 bytes each) up to which every task gets the whole model; a larger one stays sharded, and distinct words are scored by joins.
BROADCAST_ENTRIES = 3_000_000
#: Trusted ids (8 bytes each) up to which they are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Characters that are taken at a time (a longer single word is taken whole), words of one text in them, and distinct n-grams after which counts are handed on.
CHARACTERS, WORDS, HANDED_ON = 1 << 20, 100_000, 1_000_000
#: Held-out documents from which a language's own quantile is its limit. With fewer the quantile is about their maximum, which one in n + 1 good documents exceeds.
LEAST_HELD_OUT = 200


def symbols(word: str) -> list[int]:
    """A word between its marks."""
    out = [1]
    for c in map(ord, word):
        out += [WIDE + c // 1024, 3 + c % 1024] if c >= WIDE else [max(c, 3)]
    return [*out, 2]


def widths(pieces: list[str]) -> np.ndarray:
    """How many keys keys_of() gives for each piece."""
    return np.array([len(p) + 1 if p.isascii() or max(p) < chr(WIDE) else len(p) + 1 + sum(c >= chr(WIDE) for c in p) for p in pieces])


def grams(word: str) -> Iterator[tuple[int, int]]:
    """(order, key) of the longest n-gram, up to ORDER, that ends at each symbol after the first mark."""
    s, key = symbols(word), 0
    for i, c in enumerate(s):
        key = (key << BITS | c) & ((1 << BITS * ORDER) - 1)
        if i:
            yield min(i + 1, ORDER), key


def keys_of(pieces: list[str]) -> np.ndarray:
    """The keys of grams() for the words of all pieces (words joined by line feeds, none empty), in order: widths() of them for each.

    A key has no empty symbol below its first one, so its order needn't be kept.
    """
    c = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-32-le"), "<u4").astype(np.int64)
    mark, wide = c == ord("\n"), c >= WIDE
    if wide.any():
        first, mark = np.cumsum(1 + wide) - 1 - wide, np.repeat(mark, 1 + wide)
        trail, c = 3 + c[wide] % 1024, np.repeat(np.where(wide, WIDE + c // 1024, c), 1 + wide)
        c[first[wide] + 1] = trail
    c = np.maximum(c, 3)
    keys, context, open_ = np.where(mark, 2, c)[1:], np.where(mark, 1, c), np.ones(len(c) - 1, bool)
    for k in range(1, min(ORDER, len(c))):
        keys[k - 1 :] |= np.where(open_[k - 1 :], context[:-k] << BITS * k, 0)
        open_[k - 1 :] &= ~mark[:-k]
    return keys


def order_of(keys: np.ndarray) -> np.ndarray:
    return 1 + sum((keys >> BITS * k > 0).astype(np.int32) for k in range(1, ORDER))


def portions(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(places of texts, pieces for keys_of) of about CHARACTERS each. How a text is cut depends on nothing but itself."""
    places, pieces, n = [], [], 0
    for i, t in enumerate(texts):
        words = t.split()
        for k in range(0, len(words), WORDS):
            places.append(i)
            pieces.append("\n".join(words[k : k + WORDS]))
            n += len(pieces[-1])
            if n > CHARACTERS:
                yield places, pieces
                places, pieces, n = [], [], 0
    if pieces:
        yield places, pieces


def counted(texts: DataFrame) -> DataFrame:
    """(o, key, c): how often each longest n-gram occurs in all words of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (t for batch in batches for t in batch.column(0).to_pylist())
        held = pd.Series([], index=pd.Index([], dtype=np.int64), dtype=np.int64)

        def hand_on() -> pa.RecordBatch:
            keys = held.index.to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(order_of(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(held.to_numpy(), pa.int64())], ["o", "key", "c"])

        for _, pieces in portions(every):
            codes, keys = pd.factorize(keys_of(pieces))
            more = pd.Series(np.bincount(codes, minlength=len(keys)), index=keys)
            held = pd.concat([held, more]).groupby(level=0, sort=False).sum()
            if len(held) > HANDED_ON:
                yield hand_on()
                held = held.iloc[:0]
        yield hand_on()

    return texts.select("text").mapInArrow(run, "o int, key long, c long").groupBy("o", "key").agg(F.sum("c").alias("c"))


def discounts(of: list[int]) -> list[float]:
    """D1, D2 and D3+ from the number of n-grams with counts 1 to 4 (Chen and Goodman); plain defaults where there are too few."""
    if min(of[:3]) == 0:
        return [0.5, 0.75, 0.9]
    y = of[0] / (of[0] + 2 * of[1])
    return [min(k, max(0.05, k - (k + 1) * y * of[k] / of[k - 1])) for k in (1, 2, 3)]


def model_tables(counts: DataFrame) -> DataFrame:
    """(o, key, p, back): for each n-gram of each order its probability after its context, and for those that are contexts the weight of the next lower order.

    The highest order and n-grams that start a word keep their counts; others count the symbols that come before them.
    """
    counts = written(counts, "counts")
    longest, tables = counts.where(f"o = {ORDER}").select("key", "c"), {}
    tables[ORDER] = longest
    for o in range(ORDER - 1, 0, -1):
        starts = counts.where(F.col("o") == o).select("key", "c")
        # What starts a word has nothing before it, so its own counts stay; the suffixes of longer ones are all others.
        follows = tables[o + 1].groupBy((F.col("key").bitwiseAND(F.lit((1 << BITS * o) - 1))).alias("key")).agg(F.count("*").alias("c"))
        tables[o] = starts.unionByName(follows).groupBy("key").agg(F.sum("c").alias("c"))
    every = None
    for o, t in tables.items():
        t = t.select(F.lit(o).alias("o"), "key", "c")
        every = t if every is None else every.unionByName(t)
    every = written(every, "orders")
    of = {(r.o, r.c): r.n for r in every.where("c <= 4").groupBy("o", "c").agg(F.count("*").alias("n")).collect()}
    out, lower, orders = None, None, []
    for o in range(1, ORDER + 1):
        d = discounts([of.get((o, c), 0) for c in (1, 2, 3, 4)])
        t = every.where(F.col("o") == o).withColumn("context", F.shiftright("key", BITS)).withColumn("rest", F.col("key").bitwiseAND(F.lit((1 << BITS * (o - 1)) - 1)))
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum(cut).alias("freed")).withColumn("gamma", F.col("freed") / F.col("total"))
        t = t.withColumn("cut", cut).join(contexts, "context")
        t = t.withColumn("below", F.lit(UNIFORM)) if lower is None else t.join(lower.select(F.col("key").alias("rest"), F.col("p").alias("below")), "rest", "left").withColumn("below", F.coalesce("below", F.lit(UNIFORM)))
        lower = written(t.select(F.lit(o).alias("o"), "key", (F.greatest(F.lit(0.0), F.col("c") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")), "p")
        orders.append(lower)
        # The weight belongs to the context, an n-gram of the order below; order 1's is that of the empty context, kept as order 0.
        weights = contexts.select(F.lit(o - 1).alias("o"), F.col("context").alias("key"), F.col("gamma").alias("back"))
        part = lower.select("o", "key", "p", F.lit(None).cast("double").alias("back")).unionByName(weights.select("o", "key", F.lit(None).cast("double").alias("p"), "back"))
        out = part if out is None else out.unionByName(part)
    model = written(out.groupBy("o", "key").agg(F.max("p").alias("p"), F.max("back").alias("back")), "model")
    forget(counts, every, *orders)
    return model


@dataclass
class Model:
    """For each order the sorted keys of its n-grams with their probabilities, and of its contexts with their weights."""

    p: list[tuple[np.ndarray, np.ndarray]]
    back: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def _found(entries: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys have an entry, and their values (1 for the others)."""
        known, values = entries
        if not len(known):
            return np.zeros(len(keys), bool), np.ones(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        there = known[at] == keys
        return there, np.where(there, values[at], 1.0)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of n-grams' last symbols after the others."""
        out, left, order = np.full(len(keys), UNIFORM), np.arange(len(keys)), order_of(keys)
        weight = np.ones(len(keys))
        for o in range(ORDER, 0, -1):
            of = left[order[left] >= o]
            key = keys[of] & ((1 << BITS * o) - 1)
            there, p = self._found(self.p[o], key)
            out[of[there]] = p[there]
            weight[of[~there]] *= self._found(self.back[o - 1], key[~there] >> BITS)[1]
            left = np.concatenate([of[~there], left[order[left] < o]])
        return np.log(weight * out)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of logarithms and the number of symbols of each text. Equal texts get equal sums."""
        sums, symbols_of = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for places, pieces in portions(texts):
            n = widths(pieces)
            codes, keys = pd.factorize(keys_of(pieces))
            np.add.at(sums, places, np.add.reduceat(self.log_probabilities(keys)[codes], np.cumsum(n) - n))
            np.add.at(symbols_of, places, n)
        return sums, symbols_of


def collected(tables: DataFrame) -> Model:
    t = tables.toArrow()
    o, keys = t.column("o").to_numpy(), t.column("key").to_numpy()

    def by_order(name: str) -> list[tuple[np.ndarray, np.ndarray]]:
        values, out = t.column(name).to_numpy(), []
        for k in range(ORDER + 1):
            of = np.flatnonzero((o == k) & ~np.isnan(values.astype(float)))
            of = of[np.argsort(keys[of])]
            out.append((keys[of], values[of].astype(float)))
        return out

    return Model(by_order("p"), by_order("back"))


def shared_model(tables: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES):
    """The model as a broadcast, or None if it has too many entries for one."""
    return None if tables.count() > broadcast_entries else tables.sparkSession.sparkContext.broadcast(collected(tables))


def with_perplexity(docs: DataFrame, tables: DataFrame, shared) -> DataFrame:
    """docs with perplexity (null where a text has no words), by what shared_model gives; a column of that name, whatever its case, is replaced."""
    if shared is None:
        return _joined(docs, tables)

    def compute(texts: pa.Array) -> list[pa.Array]:
        sums, n = shared.value.texts(texts.to_pylist())
        return [pa.array(np.exp(-sums / np.maximum(n, 1)), pa.float64(), mask=n == 0)]

    return with_added(docs, "text", [StructField("perplexity", DoubleType())], compute)


def _joined(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """The same with the model left in its shards: distinct words are scored by joins on n-grams, documents by a join on words."""
    keep = [k for k, n in enumerate(docs.columns) if n.lower() != "perplexity"]
    own = text_or_empty(f"c{docs.columns.index('text')}")
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    named = plain.select(*(f"c{k}" for k in keep), own.alias("text"), F.xxhash64(own).alias("_d"), F.hash(own).alias("_e"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, e, w, n = [], [], [], []
            for x, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, k in Counter(t.split()).items():
                    d.append(x)
                    e.append(y)
                    w.append(word)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(e, pa.int32()), pa.array(w, pa.string()), pa.array(n, pa.int64())], ["_d", "_e", "w", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, at, o, key = [], [], [], []
            for x in batch.column(0).to_pylist():
                for i, (k, g) in enumerate(grams(x)):
                    while k >= 0:
                        w.append(x)
                        at.append(i)
                        o.append(k)
                        key.append(g & ((1 << BITS * k) - 1))
                        k -= 1
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(at, pa.int32()), pa.array(o, pa.int32()), pa.array(key, pa.int64())], ["w", "at", "o", "key"])

    texts = named.select("_d", "_e", "text").dropDuplicates(["_d", "_e"])
    counts = written(texts.mapInArrow(words, "_d long, _e int, w string, n long"), "words")
    steps = counts.select("w").distinct().mapInArrow(spell, "w string, at int, o int, key long")
    p = tables.where("p is not null").select("o", "key", "p")
    back = tables.where("back is not null").select((F.col("o") + 1).alias("o"), F.col("key").alias("context"), "back")
    found = steps.withColumn("context", F.shiftright("key", BITS)).join(p, ["o", "key"], "left").join(back, ["o", "context"], "left")
    # The longest order with a probability, times the weights of the orders above it.
    best = found.groupBy("w", "at").agg(F.max(F.when(F.col("p").isNotNull(), F.col("o"))).alias("best"), F.collect_list(F.struct("o", "p", "back")).alias("all"))
    score = F.expr(f"aggregate(all, 0D, (s, x) -> s + CASE WHEN x.o = coalesce(best, 0) AND x.o > 0 THEN ln(x.p) WHEN x.o = 0 AND best IS NULL THEN ln({UNIFORM!r}D) WHEN x.o > coalesce(best, 0) THEN ln(coalesce(x.back, 1D)) ELSE 0D END)")
    by_word = best.withColumn("s", score).groupBy("w").agg(F.sum("s").alias("s"), F.count("*").alias("k"))
    per = counts.join(by_word, "w").groupBy("_d", "_e").agg(F.exp(-F.sum(F.col("n") * F.col("s")) / F.sum(F.col("n") * F.col("k"))).alias("perplexity"))
    return named.join(per, ["_d", "_e"], "left").select(*(f"c{k}" for k in keep), "perplexity").toDF(*(docs.columns[k] for k in keep), "perplexity")


def trusted_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that a label calls good and none calls bad."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("q")).where("q >= 1").select("doc_id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


def language_limits(known: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, float | None]:
    """Limits by language (lang, limit) and the general one, from (lang, perplexity) of held-out trusted documents.

    A language with few of them has its mean logarithm and the spread that all languages share around their means, widened for how
    little a mean of n says of another document; its own quantile if that is higher.
    """
    known = known.where("perplexity is not null").withColumn("x", F.log("perplexity"))
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by = written(known.groupBy("lang").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), limit.alias("q")), "languages")
    general = known.agg(limit).first()[0]
    around = by.where("n > 1").select(F.col("lang").alias("of"), "n", "mean")
    off = (F.col("x") - F.col("mean")) * F.sqrt(F.col("n") / (F.col("n") - 1))
    spread = known.join(around, F.col("lang").eqNullSafe(F.col("of"))).agg(F.percentile_approx(off, F.lit(quantile), F.lit(10_000))).first()[0]
    shared = F.lit(general).cast("double") if spread is None else F.exp(F.col("mean") + max(0.0, spread) * F.sqrt(1 + 1 / F.col("n")))
    return by.select("lang", F.when(F.col("n") >= LEAST_HELD_OUT, F.col("q")).otherwise(F.greatest("q", shared)).alias("limit")), general


def judged(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """docs with perplexity, limit (language_limits of held-out trusted documents, the general one where a language has none) and rejected (boolean).

    The model is trained on the other trusted documents. Texts without words have no perplexity and are rejected. A null language is a
    language. Without held-out trusted text nothing has a limit and nothing but empty texts is rejected. Columns of docs that are named like
    the new ones, whatever their case, are replaced.
    """
    held_out = F.pmod(F.xxhash64(text_or_empty()), F.lit(HELD_OUT)) == 0
    tables = model_tables(counted(trusted.where(~held_out).select(text_or_empty().alias("text"))))
    shared = shared_model(tables, broadcast_entries)
    known = written(with_perplexity(trusted.where(held_out).select("lang", "text"), tables, shared).select("lang", "perplexity"), "trusted")
    limits, general = language_limits(known, quantile)
    names = [n for n in docs.columns if n.lower() not in ("perplexity", "limit", "rejected")]
    scored = with_perplexity(docs.select(*(F.col(f"`{n.replace('`', '``')}`") for n in names)), tables, shared)
    # By position, whatever the names are. A language is a row here, so Spark broadcasts the limits if they are small and splits a hot language if not.
    lang, p = f"c{names.index('lang')}", f"c{len(names)}"
    plain = scored.toDF(*(f"c{k}" for k in range(len(names) + 1)))
    met = plain.join(limits.select(F.col("lang").alias("of"), F.col("limit").alias("own")), F.col(lang).eqNullSafe(F.col("of")), "left").drop("of")
    met = met.withColumn("own", F.coalesce("own", F.lit(general).cast("double")))
    return met.withColumn("rejected", F.col(p).isNull() | F.coalesce(F.col(p) > F.col("own"), F.lit(False))).toDF(*names, "perplexity", "limit", "rejected")


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = trusted_of(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged(docs, trusted).drop("text")


QUERIES = {"op3_kneser_ney_quality": op3_kneser_ney_quality}
