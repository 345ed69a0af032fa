"""Functions and decisions on small cases."""

import pytest

from folioscope.functions import search, text
from folioscope.operators import policies


def test_page_selection():
    assert policies.select_pages("1-3, 5,5", 8) == [1, 2, 3, 5]
    assert policies.select_pages("6-", 8) == [6, 7, 8] and policies.select_pages("-2", 8) == [1, 2]
    assert policies.select_pages(" , ", 8) == [] and policies.select_pages(None, 2) == [1, 2]
    for bad in ("3-1", "9", "0", "x", "-", "7-9", "3 5"):
        with pytest.raises(ValueError):
            policies.select_pages(bad, 8)


def test_jaro_winkler():
    assert round(text.jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert round(text.jaro_winkler_of("abcxxxxxx", "abcyyyyyy"), 4) == 0.6889
    assert text.jaro_winkler_of("", "a") == 0 and text.jaro_winkler_of("", "") == 1


def test_bags():
    assert text.dice_of("aa", "aa") == 1 and text.dice_of("a", "b") == 0 and text.dice_of("night", "nacht") == 0.25
    assert text.cosine_of([], []) == 1 and text.cosine_of([], ["a"]) == 0
    assert text.word_distance_of(["a", "b", "c"], ["a", "c"]) == 1


def test_normalise(spark):
    from pyspark.sql import functions as F

    rows = [("Straße — „Œuvre“  Nº 5",), ("co-\noperate ~~ ok",), ("",), (None,), ("ﬁne",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalise(F.col("t"))).collect()]
    assert got == ['strase "oeuvre" no 5', "cooperate ok", "", None, "fine"]


def brute(needle, hay):
    d = list(range(len(needle) + 1))
    out = []
    for c in hay:
        last, d[0] = d[0], 0
        for i, n in enumerate(needle, 1):
            last, d[i] = d[i], min(d[i] + 1, d[i - 1] + 1, last + (n != c))
        out.append(d[-1])
    return out


def test_search():
    assert search.approximate_search("invoice", "an invoce, an invoice") == [(14, 21, 0, 1.0), (11 - 8, 10 - 1, 1, 1 - 1 / 7)]
    assert search.best_match("invoice", "an invoce, an invoice") == (14, 21, 0, 1.0) and search.best_match("zzz", "abc") is None
    assert search.approximate_search("12.50", "x 112.50 y") == []
    assert search.approximate_search("", "abc") == [] and search.approximate_search("abc", "") == []
    for needle, hay in (("abca", "xabxcabca"), ("hello", "yellow helo"), ("aaa", "aaaa")):
        assert search._table(needle, hay)[-1][1:].tolist() == brute(needle, hay)
    assert search.word_span("one two three", 5, 6) == (4, 7)


def test_pdf_dates(spark):
    from pyspark.sql import functions as F

    rows = [("D:20240229123000Z",), ("D:2024",), ("D:20241301",), ("D:20240101000000+01'30'",), ("nonsense",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(policies.pdf_date(F.col("t")).cast("timestamp_ntz").cast("string")).collect()]
    assert got == ["2024-02-29 12:30:00", "2024-01-01 00:00:00", "2025-01-01 00:00:00", "2023-12-31 22:30:00", None, None]
