"""Decisions of the comparison as columns: pages, resolutions, margins, kinds, placements, verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolution limits in dpi, share of a page that a scan covers, bleed in points, paper in points.
DPI_DEFAULT, DPI_LEAST, DPI_MOST = 200.0, 72.0, 400.0
SCAN_COVERAGE = 0.8
BLEED = 6.0
PAPER = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}
RECORDED_DPI, FALLBACK_DPI = 100.0, 150.0


def select_pages(selection: str | None, pages: int) -> list[int]:
    """Pages of '1-3,5', '4-', '-2'; sorted, once each; None is all. Unreadable, backwards and out-of-range parts raise ValueError."""
    if selection is None:
        return list(range(1, pages + 1))
    out = set()
    for part in selection.split(","):
        part = part.strip()
        if not part:
            continue
        m = re.fullmatch(r"(\d*)\s*(-?)\s*(\d*)", part)
        if not m or not (m[1] or m[3]) or (m[3] and not m[2]):
            raise ValueError(f"can't read {part!r}")
        first = int(m[1]) if m[1] else 1
        last = (int(m[3]) if m[3] else pages) if m[2] else first
        if first > last:
            raise ValueError(f"{part!r} goes backwards")
        if first < 1 or last > pages:
            raise ValueError(f"{part!r} is outside 1 to {pages}")
        out.update(range(first, last + 1))
    return sorted(out)


def native_dpi(effective: Column) -> Column:
    return F.least(F.greatest(F.coalesce(effective, F.lit(DPI_DEFAULT)), F.lit(DPI_LEAST)), F.lit(DPI_MOST))


def matched_dpi(dpi: Column, width: Column, height: Column, other_width: Column, other_height: Column) -> Column:
    """The other side's dpi at which the papers have equally many pixels; papers within a tenth count as the same size."""
    r = F.least(F.greatest(width, height) / F.greatest(other_width, other_height), F.least(width, height) / F.least(other_width, other_height))
    return F.least(F.greatest(dpi * F.when(F.abs(r - 1) <= 0.1, F.lit(1.0)).otherwise(r), F.lit(DPI_LEAST)), F.lit(DPI_MOST))


def resolved_bleed(side: Column, every: Column, fallback: Column | float = BLEED) -> Column:
    """The side's own, else that of all sides, else the fallback; a negative or non-finite one is an error."""
    b = F.coalesce(side, every, F.lit(fallback) if isinstance(fallback, float) else fallback)
    bad = (b < 0) | F.isnan(b) | (b == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad bleed "), b.cast("string"))).cast("double")).otherwise(b)


def page_kind(coverage: Column, characters: Column, draws: Column) -> Column:
    scanned = coverage >= SCAN_COVERAGE
    return F.when(scanned & (characters > 0), "scanned-with-text-layer").when(scanned, "scanned").when((characters > 0) | draws | (coverage > 0), "vector").otherwise("empty")


def placement_dpi(given: Column, recorded: Column) -> Column:
    return F.when(given > 0, given).when(recorded >= RECORDED_DPI, recorded).otherwise(F.lit(FALLBACK_DPI))


def placed(width: Column, height: Column, paper: tuple[float, float], margin: float) -> dict[str, Column]:
    """An image on paper, landscape if it is wider than high: scale, page size and where its lower left corner lies."""
    wide = width > height
    pw, ph = (F.when(wide, F.lit(paper[1 - k])).otherwise(F.lit(paper[k])) for k in (0, 1))
    s = F.least((pw - 2 * margin) / width, (ph - 2 * margin) / height)
    return {"page_width": pw, "page_height": ph, "scale": s, "x": (pw - width * s) / 2, "y": (ph - height * s) / 2}


def half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity, also below zero."""
    return F.floor(c + 0.5)


def parallel(a: Column, b: Column) -> Column:
    """Angles within a degree of each other, around the circle."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d) <= 1


def text_verdict(findings: Column, score: Column, least: float = 0.85) -> Column:
    return F.when((findings > 0) | (score < least), "review").otherwise("pass")


def plausible(m: Column, ratio: float = 8.0) -> Column:
    """A transform (nine doubles by rows) that is finite, doesn't mirror and scales within ratio."""
    g = lambda i: F.get(m, i)
    finite = ~F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    det = g(0) * g(4) - g(1) * g(3)
    norms = [F.sqrt(g(i) * g(i) + g(i + 3) * g(i + 3)) for i in (0, 1)]
    return F.coalesce(finite & (det > 1e-9) & (norms[0].between(1 / ratio, ratio)) & (norms[1].between(1 / ratio, ratio)), F.lit(False))


def pdf_date(c: Column) -> Column:
    """D:YYYY[MM[DD[hh[mm[ss]]]]][+-Zhh'mm'] as a UTC timestamp; missing parts are the first, too large ones roll over, others give null."""
    pattern = r"^D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+\-Z])(?:(\d{2})'?(?:(\d{2})'?)?)?)?$"
    part = lambda k, otherwise: F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int"), F.lit(otherwise))
    months = part(1, 0) * 12 + part(2, 1) - 1
    day = F.add_months(F.lit("0000-01-01").cast("date"), months)
    seconds = (F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("long") + part(3, 1) - 1) * 86400 + part(4, 0) * 3600 + part(5, 0) * 60 + part(6, 0)
    sign = F.when(F.regexp_extract(c, pattern, 7) == "-", -1).otherwise(1)
    return F.when(c.rlike(pattern), F.timestamp_seconds(seconds - sign * (part(8, 0) * 3600 + part(9, 0) * 60)))


def settlement(c: dict[str, Column]) -> Column:
    """What a disputed text difference is, by rules in order: 'changed', 'misread' or 'unsettled'.

    c: print_check, ink_mm2, kind, glyph, order, agreeing_passes, sides_alike. The budget is 40 disputes, two of three passes agree.
    """
    return (
        F.when(c["print_check"] == "changed", "changed")
        .when(c["print_check"] == "unchanged", "misread")
        .when(c["ink_mm2"] >= 0.3, "changed")
        .when(c["kind"] != "changed", "unsettled")
        .when(c["glyph"] == "confirmed", "misread")
        .when(c["glyph"] == "other", "changed")
        .when(c["order"] > 40, "unsettled")
        .when((c["agreeing_passes"] >= 2) & c["sides_alike"], "misread")
        .otherwise("unsettled")
    )
