"""Numbers as the comparison's original runtime has them: text to number, 32-bit wrapping, civil dates, small linear systems."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_DECIMAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: Milliseconds from the epoch beyond which there is no date.
DATE_LIMIT = 8.64e15


def _sum_of(digits: Column, base: float) -> Column:
    return F.aggregate(digits, F.lit(0.0), lambda s, d: s * base + F.conv(d, 16, 10).cast("double"))


def text_number(c: Column) -> Column:
    """The number a text stands for: decimal, 0x, 0o or 0b, Infinity with a sign; nothing but white space is 0, anything else NaN."""
    t = F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")
    radix = F.lit(math.nan)
    for letter, base, digits in (("x", 16.0, "0-9a-fA-F"), ("o", 8.0, "0-7"), ("b", 2.0, "01")):
        each = F.filter(F.split(F.substr(t, F.lit(3)), ""), lambda d: d != "")
        radix = F.when(t.rlike(f"^0[{letter}{letter.upper()}][{digits}]+$"), _sum_of(each, base)).otherwise(radix)
    signed = F.when(t.startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf))
    return F.when(c.isNotNull(), F.when(t == "", F.lit(0.0)).when(t.rlike("^[+-]?Infinity$"), signed).when(t.rlike(f"^{_DECIMAL}$"), t.try_cast("double")).otherwise(radix))


def int32(c: Column) -> Column:
    """A double wrapped to 32 bits with a sign; those that aren't finite are 0."""
    # Doubles from 2 ** 53 on are whole, and may be beyond a long.
    whole = F.when(F.abs(c) >= 2.0**53, c).otherwise(F.signum(c) * F.floor(F.abs(c)).cast("double"))
    low = F.pmod(whole, F.lit(4294967296.0))
    wrapped = F.when(low >= 2147483648.0, low - 4294967296.0).otherwise(low)
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), F.lit(0)).otherwise(wrapped.cast("int"))


def uint32(c: Column) -> Column:
    """The same without a sign, as a long."""
    return F.pmod(int32(c).cast("long"), F.lit(4294967296))


def multiply32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit integers, with a sign; by halves, so that a long holds each part."""
    x, y = uint32(a.cast("double")), uint32(b.cast("double"))
    high = F.pmod(x * F.floor(y / 65536), F.lit(65536)) * 65536
    low = F.pmod(x * F.pmod(y, F.lit(65536)) + high, F.lit(4294967296))
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int")


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 of a date whose month (1 to 12) and day may lie outside the calendar and roll over."""
    months = year.cast("long") * 12 + month.cast("long") - 1
    y, m = F.floor(months / 12), F.pmod(months, F.lit(12)) + 1
    # Years that start in March, in eras of 400.
    y = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * F.pmod(m + 9, F.lit(12)) + 2) / 5)
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468 + day.cast("long") - 1


def date_utc(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Milliseconds from the epoch; months count from 0, years below 100 are of the twentieth century, fields outside their range roll over, and beyond DATE_LIMIT there is none (null)."""
    year = F.when(year.between(0, 99), year + 1900).otherwise(year)
    ms = civil_days(year, month + 1, day).cast("double") * 86_400_000 + hour * 3_600_000.0 + minute * 60_000.0 + second * 1000.0
    return F.when(F.abs(ms) <= DATE_LIMIT, ms)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """x of a x = b by elimination with the largest pivot of each column; None if one is below 1e-12."""
    m = np.concatenate([np.array(a, float), np.array(b, float).reshape(-1, 1)], 1)
    n = len(m)
    for k in range(n):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if abs(m[p, k]) < 1e-12:
            return None
        m[[k, p]] = m[[p, k]]
        m[k + 1 :, k:] -= np.outer(m[k + 1 :, k] / m[k, k], m[k, k:])
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, n] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) of a symmetric matrix by cyclic rotations, in the order of the diagonal."""
    a = np.array(a, float)
    n = len(a)
    v = np.eye(n)
    for _ in range(sweeps):
        if (np.triu(a, 1) ** 2).sum() < 1e-24:
            break
        for p in range(n):
            for q in range(p + 1, n):
                if abs(a[p, q]) < 1e-18:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
                c = 1 / math.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q]] = turn.T @ a[[p, q]]
                v[:, [p, q]] = v[:, [p, q]] @ turn
    return np.diag(a).copy(), v


def smallest_vector(a: np.ndarray) -> np.ndarray:
    """The unit eigenvector of the smallest eigenvalue (the first of equal ones)."""
    values, vectors = eigen(a)
    v = vectors[:, int(np.argmin(values))]
    length = float(np.sqrt(v @ v))
    return v / length if length else v


def written_number(text: str) -> float:
    """text_number for a single text."""
    t = re.sub(f"^{_BLANK}+|{_BLANK}+$", "", text)
    if not t:
        return 0.0
    for letter, base, digits in (("x", 16, "0-9a-fA-F"), ("o", 8, "0-7"), ("b", 2, "01")):
        if re.fullmatch(f"0[{letter}{letter.upper()}][{digits}]+", t):
            return float(int(t[2:], base))
    if re.fullmatch("[+-]?Infinity", t):
        return -math.inf if t[0] == "-" else math.inf
    return float(t) if re.fullmatch(_DECIMAL, t) else math.nan
