"""Approximate substring search: the places where a needle stands within a number of edits."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MIN_SCORE = 0.85
PLACES = "array<struct<start:int,end:int,distance:int,score:double>>"


def _table(needle: str, text: str) -> np.ndarray:
    """Edit distances of each prefix of needle to the best substring that ends at each place."""
    m, n = len(needle), len(text)
    d = np.zeros((m + 1, n + 1), np.int32)
    d[:, 0] = np.arange(m + 1)
    chars = np.array([ord(c) for c in text], np.int64)
    ramp = np.arange(n + 1)
    for i, c in enumerate(map(ord, needle), 1):
        # Vertical and diagonal steps at once; horizontal ones by a running minimum.
        row = np.empty(n + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(d[i - 1, 1:] + 1, d[i - 1, :-1] + (chars != c))
        d[i] = np.minimum.accumulate(row - ramp) + ramp
    return d


def _start(d: np.ndarray, needle: str, text: str, end: int) -> int:
    i, j = len(needle), end
    while i:
        if j and d[i, j] == d[i - 1, j - 1] + (needle[i - 1] != text[j - 1]):
            i, j = i - 1, j - 1
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return j


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _fits(needle: str, text: str, a: int, b: int) -> bool:
    """Figures must be the same and not go on; a lone letter must stand as a word."""
    if _digits(needle) != _digits(text[a:b]):
        return False
    if _digits(needle) and ((needle[:1].isdigit() and a and text[a - 1].isdigit()) or (needle[-1:].isdigit() and text[b : b + 1].isdigit())):
        return False
    lone = [w for w in needle.split() if len(w) == 1 and w.isalpha()]
    if lone:
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        words = text[a:b].split()
        for w in lone:
            if w not in words:
                return False
            words.remove(w)
    return True


def approximate_search(needle: str, text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, int, float]]:
    """(start, end, distance, score) of places that don't overlap, the best (fewest edits, then first) first; of overlapping ones the best stays. Offsets are code points."""
    m = len(needle)
    if not m or not text:
        return []
    most = int(np.floor((1 - min_score) * m + 1e-9))
    d = _table(needle, text)
    ends = [int(e) for e in np.flatnonzero(d[m] <= most) if e]
    found: list[tuple[int, int, int, float]] = []
    for e in sorted(ends, key=lambda e: (d[m, e], e)):
        s = _start(d, needle, text, e)
        if s < e and all(e <= a or s >= b for a, b, *_ in found) and _fits(needle, text, s, e):
            found.append((s, e, int(d[m, e]), 1 - int(d[m, e]) / m))
    return found


def best_match(needle: str, text: str, min_score: float = MIN_SCORE) -> tuple[int, int, int, float] | None:
    """The best place, or None."""
    return next(iter(approximate_search(needle, text, min_score)), None)


def search_column(needle, text, min_score: float = MIN_SCORE):
    """Places of a needle column in a text column; both normalised. Null gives null."""

    def run(n: pd.Series, t: pd.Series) -> pd.Series:
        name = ("start", "end", "distance", "score")
        return pd.Series([None if a is None or b is None else [dict(zip(name, p, strict=True)) for p in approximate_search(a, b, min_score)] for a, b in zip(n, t, strict=True)])

    return F.pandas_udf(run, PLACES, F.PandasUDFType.SCALAR)(F.col(needle) if isinstance(needle, str) else needle, F.col(text) if isinstance(text, str) else text)


#: Bytes of needles up to which every worker gets all of them, and pages are read and looked through once.
HELD = 4 << 20


def contained(pages: DataFrame, needles: DataFrame, page: str, item: str) -> DataFrame:
    """Pairs (page, item) of normalised pages (page, hay) that contain needles (item, needle); equal rows of either side count each.

    A needle's inner words stand in a page as whole words, so a page is looked through only for needles of which it has such a word; needles of
    less than three words have none and are looked for in every page. Needles beyond HELD bytes are joined on words; both ways give the same pairs.
    """
    asked, rows = needles.where("needle is not null").select(item, "needle"), pages.select(page, "hay")
    size = asked.agg(F.sum(F.octet_length("needle").cast("long"))).first()[0] or 0
    return _looked_through(rows, asked, page, item) if size <= HELD else _met(rows, asked, page, item)


def _looked_through(rows: DataFrame, asked: DataFrame, page: str, item: str) -> DataFrame:
    """By needles that every worker has, under their longest inner word."""
    held = asked.toDF("item", "needle").toArrow().combine_chunks()
    found, items = held.column("needle").to_pylist(), held.column("item").combine_chunks()
    schema = StructType([rows.schema[page], asked.schema[item]])

    def run(batches):
        by_word, short = {}, []
        for k, needle in enumerate(found):
            inner = needle.split(" ")[1:-1]
            if inner:
                by_word.setdefault(max(inner, key=len), []).append(k)
            else:
                short.append(k)
        for b in batches:
            at, which = [], []
            for i, hay in enumerate(b.column(1)):
                text = hay.as_py()
                if text is None:  # not a filter before, which would have every text normalised twice
                    continue
                here = [k for w in by_word.keys() & set(text.split(" ")) for k in by_word[w] if found[k] in text]
                here += [k for k in short if found[k] in text]
                at += [i] * len(here)
                which += here
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), items.take(pa.array(which, pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema)


def _met(rows: DataFrame, asked: DataFrame, page: str, item: str) -> DataFrame:
    """By joins of pages and needles on the needle's rarest inner word."""
    words = lambda c: F.split(c, " ")
    needles = asked.select("needle").distinct().withColumn("_w", words(F.col("needle")))
    inner = needles.where("size(_w) > 2").select("needle", F.explode(F.array_distinct(F.expr("slice(_w, 2, size(_w) - 2)"))).alias("_key"))
    rows = rows.where("hay is not null").withColumn("_h", F.xxhash64("hay"))
    spoken = rows.select(F.col(page).alias("_p"), "_h", F.explode(F.array_distinct(words(F.col("hay")))).alias("_key")).join(inner.select("_key").distinct(), "_key", "left_semi")
    often = spoken.groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = inner.join(often, "_key").groupBy("needle").agg(F.min(F.struct("_n", "_key"))["_key"].alias("_key"), F.count("*").alias("_found"))
    # A needle with an inner word that no page has is in none.
    whole = inner.groupBy("needle").agg(F.count("*").alias("_all"))
    rarest = rarest.join(whole, "needle").where("_found = _all").select("needle", "_key")
    met = spoken.join(rarest, "_key").select("_p", F.col("_h").alias("_g"), "needle").distinct()
    long = rows.join(met, F.col(page).eqNullSafe(F.col("_p")) & (F.col("_h") == F.col("_g"))).where(F.contains("hay", "needle")).select(page, "needle")
    short = rows.join(needles.where("size(_w) < 3").select("needle"), F.contains("hay", "needle")).select(page, "needle")
    return long.unionByName(short).join(asked, "needle").select(page, item)


def word_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span widened to white space."""
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end
