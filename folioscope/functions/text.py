"""Text normalisation and similarity as columns, and the few metrics that need Python."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what they are read as - single quotes and prime, double quotes and double prime, hyphens and dashes,
# ellipsis, no-break and typographic spaces, and what has no width.
TYPOGRAPHY = (
    dict.fromkeys("\u2018\u2019\u201a\u201b\u2032", "'")
    | dict.fromkeys("\u201c\u201d\u201e\u201f\u2033", '"')
    | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-")
    | {"\u2026": "..."}
    | dict.fromkeys(["\u00a0", *map(chr, range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000"], " ")
    | dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff", "")
)
# Letters whose name doesn't say what they fold to.
FOLDED = {"\u0131": "i", "\u0149": "n", "\u017f": "l", "\u1e9b": "s", "\u008c": "OE", "\u009c": "oe"}
# Where letters that fold lie, and those there that don't.
LETTERS = [*range(0xC0, 0x250), 0x250, 0x253, 0x254, 0x256, 0x257, 0x25B, 0x260, 0x265, 0x268, 0x26B, 0x26F, 0x271, 0x272, 0x275, 0x27D, 0x288, 0x289, 0x28B, 0x28C, 0x1D79, 0x1D7D, *range(0x1E00, 0x1F00), 0x2184, *range(0x24B6, 0x24EA), *range(0x2C60, 0x2C80), *range(0xA728, 0xA76A), *range(0xA779, 0xA78E), 0xA790, 0xA791, *range(0xA7A0, 0xA7AA), *range(0xFF21, 0xFF5B)]
KEPT = {0x132, 0x133, 0x1AB, 0x237, 0x246}
# Shapes that readers take for each other, pairs first.
CONFUSED = {"rn": "m", "cl": "d", "vv": "w", "0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "8": "b", "6": "b", "2": "z"}
_LETTER = re.compile(r"(?:CIRCLED |FULLWIDTH )?LATIN (CAPITAL|SMALL) (?:LETTER|LIGATURE) (?:(?:SMALL|OPEN|REVERSED|TURNED|INSULAR|BROKEN|BARRED|SHARP|AFRICAN|HALF) )*([A-Z]{1,2})(?: BAR| WITH SMALL LETTER ([A-Z])(?: WITH .*)?| WITH (?!CURL|RIGHT HOOK|NOTCH|LOW RING|RETROFLEX HOOK AND BELT)[^,]*)?")


def diacritics() -> dict[str, str]:
    """Latin letters with marks, hooks, strokes, circles, other widths or turned, and ligatures, by the plain letters that their Unicode names say."""
    out = {}
    for code in LETTERS:
        m = _LETTER.fullmatch(unicodedata.name(chr(code), ""))
        # A turned letter with a tail, or a small one among capitals' names, is a letter of its own.
        if m and code not in KEPT and "TURNED R" not in m[0] and "SMALL CAPITAL" not in m[0]:
            base = m[2] + m[3].lower() if m[3] else m[2] if m[1] == "CAPITAL" else m[2].lower()
            out[chr(code)] = base
    return out | FOLDED


_PLAIN, _FOLDS = str.maketrans(TYPOGRAPHY), str.maketrans(diacritics())
_LINE_END = re.compile(r"(?<=[^\W\d_])[-\u00ad\u2010\u2011][ \t]*\r?\n[ \t]*(?=[^\W\d_A-Z])")


def _about(letters) -> str:
    """A short class of characters that has all letters, those of Latin-1 exactly and others by ranges that may have more: Java tries every part of a class in turn."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if spans and code > 0xFF and spans[-1][0] > 0xFF and code - spans[-1][1] <= 64:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def _replaced(c: Column, table: dict[str, str]) -> Column:
    """Single characters in one translate; the rest one by one, in order."""
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) <= 1}
    # translate drops characters that have no counterpart, so those come last.
    order = sorted(single, key=lambda k: not single[k])
    for k, v in table.items():
        if len(k) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    # Letters that become two are rare: a text without any is looked through once.
    long = {k: v for k, v in table.items() if len(k) == 1 and len(v) > 1}
    if long:
        out = c
        for k, v in long.items():
            out = F.replace(out, F.lit(k), F.lit(v))
        c = F.when(c.rlike(_about(long)), out).otherwise(c)
    return F.translate(c, "".join(order), "".join(single[k] for k in order)) if order else c


def fold_diacritics(c: Column) -> Column:
    return _replaced(c, diacritics())


def fold_confusables(c: Column) -> Column:
    """Pairs first (rn, cl, vv), then single characters."""
    return _replaced(c, CONFUSED)


def fold_typography(c: Column) -> Column:
    return _replaced(c, TYPOGRAPHY)


def _series(f, kind: str):
    """A function of pandas columns as a column function; made where it is used, as workers import this module too."""

    def put(*columns):
        def run(*s: pd.Series) -> pd.Series:
            return f(*s)

        return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*columns)

    return put


nfkc = _series(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)), "string")


#: Common characters that NFKC leaves as they are, alone and beside each other: a text of nothing else needn't leave the JVM.
STABLE = r"\u0000-\u007f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u2013\u2014\u2018-\u201e\u2022\u20ac"


def compatible(c: Column) -> Column:
    """NFKC; only texts that it may change go to Python."""
    return F.coalesce(nfkc(F.when(c.rlike(f"[^{STABLE}]"), c)), c)


def dehyphenate(c: Column) -> Column:
    """A word broken at a line's end, by any hyphen, is joined if it goes on in lower case."""
    return F.regexp_replace(c, r"(\p{L})[-\u00ad\u2010\u2011][ \t]*\r?\n[ \t]*(?=\p{Ll})", "$1")


#: White space as a class of regular expressions: Unicode's, and the byte-order mark.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def drop_noise(c: Column) -> Column:
    """Tokens without a letter, a number or a currency sign go."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), r"(?<![^ ])[^ \p{L}\p{N}\p{Sc}]++(?![^ ])", ""), " {2,}", " "))


def normalise(c: Column, compatibility: bool = True, punctuation: bool = True, confusables: bool = False, typography: bool = True, dehyphenation: bool = True, folding: bool = True, case: bool = True, noise: bool = True) -> Column:
    """NFKC, typography, dehyphenation, diacritics, lower case, noise, [punctuation], [confusables], white space - in this order, each unless turned off."""
    c = compatible(c) if compatibility else c
    c = fold_typography(c) if typography else c
    c = dehyphenate(c) if dehyphenation else c
    c = fold_diacritics(c) if folding else c
    c = F.lower(c) if case else c
    c = drop_noise(c) if noise else c
    if not punctuation:
        c = F.regexp_replace(c, r"\p{P}+", " ")
    # Without noise a text is collapsed already.
    return collapse(fold_confusables(c) if confusables else c) if confusables or not punctuation or not noise else c


def normalised_of(text: str) -> str:
    """normalise() with its defaults, for a single text."""
    t = unicodedata.normalize("NFKC", text).translate(_PLAIN)
    t = _LINE_END.sub("", t).translate(_FOLDS).lower()
    return " ".join(w for w in t.split() if any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Sc" for c in w))


def keys_of(text: str) -> list[str]:
    """keys() for a single text."""
    edge = lambda c: unicodedata.category(c)[0] == "P"
    out = []
    for w in normalised_of(text).split():
        a, b = 0, len(w)
        while a < b and edge(w[a]):
            a += 1
        while b > a and edge(w[b - 1]):
            b -= 1
        if a < b:
            out.append(w[a:b])
    return out


def edge_trimmed(c: Column) -> Column:
    """A word without punctuation at its ends."""
    return F.regexp_replace(c, r"^\p{P}+|\p{P}+$", "")


def keys(c: Column) -> Column:
    """The words of a normalised text without punctuation at their ends; those of nothing else go."""
    return F.filter(F.transform(tokens(c), edge_trimmed), lambda x: x != "")


def tokens(normalised: Column) -> Column:
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(F.split(normalised, " "))


def ratio(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return ratio(F.levenshtein(a, b), a, b)


def error_rate(expected: Column, actual: Column) -> Column:
    """Edits by the expected length; nothing expected: 0 if nothing is there, else 1. Not clamped."""
    return F.when(F.length(expected) == 0, F.when(F.length(actual) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(expected, actual) / F.length(expected))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; both empty: 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def word_recall(expected: Column, actual: Column) -> Column:
    """Share of the expected tokens, as a bag, that are there; nothing expected: 1."""
    have = F.aggregate(F.array_distinct(expected), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(expected, lambda x: x == t)), F.size(F.filter(actual, lambda x: x == t))))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(have / F.size(expected))


def cosine_of(a: list[str], b: list[str]) -> float:
    """Of term counts; both empty: 1, one empty: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = Counter(a), Counter(b)
    return sum(n * y[t] for t, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def dice_of(a: str, b: str) -> float:
    """Of bigram bags; equal: 1, else under two characters: 0."""
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def jaro_winkler_of(a: str, b: str) -> float:
    """Prefix scale 0.1 up to four characters at any score; half transpositions count."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for j, y in enumerate(b) if taken[j]]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return jaro + min(4, prefix) * 0.1 * (1 - jaro)


def _pairwise(f, kind: str, dtype: str):
    return _series(lambda a, b: pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=dtype), kind)


jaro_winkler = _pairwise(jaro_winkler_of, "double", "float64")
dice = _pairwise(dice_of, "double", "float64")
cosine = _pairwise(cosine_of, "double", "float64")


def word_distance_of(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


word_distance = _pairwise(lambda a, b: word_distance_of(list(a), list(b)), "int", "Int32")


def word_error_rate(expected: Column, actual: Column) -> Column:
    return F.when(F.size(expected) == 0, F.when(F.size(actual) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(word_distance(expected, actual) / F.size(expected))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def compare_texts(expected: Column, actual: Column) -> Column:
    """All metrics of two normalised texts in one struct."""
    a, b = tokens(expected), tokens(actual)
    return F.struct(
        F.levenshtein(expected, actual).alias("levenshtein"),
        levenshtein_similarity(expected, actual).alias("levenshtein_similarity"),
        jaccard(a, b).alias("jaccard"),
        dice(expected, actual).alias("dice"),
        cosine(a, b).alias("cosine"),
        jaro_winkler(expected, actual).alias("jaro_winkler"),
        error_rate(expected, actual).alias("character_error_rate"),
        word_error_rate(a, b).alias("word_error_rate"),
        word_recall(a, b).alias("word_recall"),
        F.when(F.length(expected) == 0, F.when(F.length(actual) == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))).otherwise(F.length(actual) / F.length(expected)).alias("length_ratio"),
        F.length(expected).alias("characters"),
    )
