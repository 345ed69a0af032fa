"""Measures of ink in rectangles of a page, print extent, resizing and corners, on numpy arrays; masks are boolean, rectangles (x, y, w, h) in pixels."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

import numpy as np

from folioscope.functions.raster import MM_PER_INCH, components, correlation, dilate, merge_boxes

Rect = tuple[float, float, float, float]


def clipped(rect: Rect, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    """Rows and columns (top, bottom, left, right) that a rectangle touches."""
    x, y, w, h = rect
    return max(0, math.floor(y)), min(shape[0], math.ceil(y + h)), max(0, math.floor(x)), min(shape[1], math.ceil(x + w))


class Masks:
    """Ink of a page and of its scan, registered, each also grown by the tolerance: ink is new or lost only outside the other's grown ink."""

    def __init__(self, original: np.ndarray, scan: np.ndarray, tolerance: int = 2):
        if original.shape != scan.shape:
            raise ValueError("the masks differ in size")
        self.original, self.scan = original.astype(bool), scan.astype(bool)
        self.added, self.lost, self.shared = self.scan & ~dilate(self.original, tolerance), self.original & ~dilate(self.scan, tolerance), self.original & self.scan
        self.shape = original.shape


def probe(masks: Masks, rect: Rect, dpi: float = 150.0) -> dict[str, float]:
    """Added, lost and shared ink of a rectangle (in points) in mm2."""
    t, b, lft, r = clipped(tuple(v * dpi / 72 for v in rect), masks.shape)
    mm2 = (MM_PER_INCH / dpi) ** 2
    return {name: int(np.count_nonzero(m[t:b, lft:r])) * mm2 if b > t and r > lft else 0.0 for name, m in (("added", masks.added), ("lost", masks.lost), ("shared", masks.shared))}


def coverage(mask: np.ndarray, rect: Rect | None = None) -> float:
    """Share of a rectangle (None: all) that is ink."""
    t, b, lft, r = clipped(rect, mask.shape) if rect else (0, mask.shape[0], 0, mask.shape[1])
    return float(mask[t:b, lft:r].mean()) if b > t and r > lft else 0.0


def region_report(masks: Masks, rect: Rect, threshold: float = 0.02) -> dict:
    """Shares of a rectangle: ink before and after, added, removed; filled from the threshold on, and score, its share of the threshold up to 1."""
    added = coverage(masks.added, rect)
    t, b, lft, r = clipped(rect, masks.shape)
    there = b > t and r > lft
    return {"original_ink": coverage(masks.original, rect), "scan_ink": coverage(masks.scan, rect), "added": added, "removed": coverage(masks.lost, rect), "filled": there and added >= threshold, "score": min(1.0, added / threshold) if there and threshold > 0 else 0.0}


def added_share(box: dict, regions: Iterable[Rect], masks: Masks) -> float:
    """Share of a merged box's added ink that lies in regions, each pixel once."""
    inside = np.zeros((box["h"], box["w"]), bool)
    x0, y0 = box["x"], box["y"]
    for rect in regions:
        t, b, lft, r = clipped(rect, (y0 + box["h"], x0 + box["w"]))
        t, lft = max(t, y0), max(lft, x0)
        if b > t and r > lft:
            inside[t - y0 : b - y0, lft - x0 : r - x0] = True
    n = int(np.count_nonzero(inside & masks.added[y0 : y0 + box["h"], x0 : x0 + box["w"]]))
    return min(1.0, n / box["pixels"]) if box["pixels"] > 0 else 0.0


def region_ink(added: np.ndarray, rect: Rect, gap: int, least: int, span: float = 0.9, thickness: float = 2.0, thickness_ratio: float = 0.05, edge_band: float = 0.05) -> dict:
    """The new ink of an expected region: specks under two pixels and form rules (spanning a side, thin) don't count, the rest is merged and small changes go.

    pixels, changes, largest, bounds (x, y, w, h or None), edge_touch (share of them in the band along the sides), fill and form_lines.
    """
    t, b, lft, r = clipped(rect, added.shape)
    out = {"pixels": 0, "changes": 0, "largest": 0, "bounds": None, "edge_touch": 0.0, "fill": 0.0, "form_lines": 0}
    h, w = b - t, r - lft
    if w <= 0 or h <= 0:
        return out
    crop = added[t:b, lft:r]
    pieces = [c for c in components(crop) if c["pixels"] >= 2]
    rule = lambda c: (c["w"] >= span * w and c["h"] <= max(thickness, thickness_ratio * h)) or (c["h"] >= span * h and c["w"] <= max(thickness, thickness_ratio * w))
    written = [c for c in pieces if not rule(c)]
    out["form_lines"] = len(pieces) - len(written)
    changes = [c for c in merge_boxes(written, gap) if c["pixels"] >= least]
    if not changes:
        return out
    held = [c for c in written if any(m["x"] <= c["x"] and m["y"] <= c["y"] and c["x"] + c["w"] <= m["x"] + m["w"] and c["y"] + c["h"] <= m["y"] + m["h"] for m in changes)]
    # Only ink of the pieces that count: each piece's own pixels, not whatever else its box holds.
    kept = np.zeros(crop.shape, bool)
    for c in held:
        kept |= piece_mask(crop, c)
    pixels, band = int(np.count_nonzero(kept)), max(1, math.floor(min(w, h) * edge_band + 0.5))
    inner = int(np.count_nonzero(kept[band : h - band, band : w - band])) if h > 2 * band and w > 2 * band else 0
    left, top = min(c["x"] for c in changes), min(c["y"] for c in changes)
    right, bottom = max(c["x"] + c["w"] for c in changes), max(c["y"] + c["h"] for c in changes)
    return out | {"pixels": pixels, "changes": len(changes), "largest": max(c["pixels"] for c in changes), "bounds": (lft + left, t + top, right - left, bottom - top), "edge_touch": (pixels - inner) / pixels if pixels else 0.0, "fill": pixels / (w * h)}


def piece_mask(mask: np.ndarray, piece: dict) -> np.ndarray:
    """The pixels of one connected piece (as components() describes it), grown from a pixel of its first row within its box."""
    y0, x0, h, w = piece["y"], piece["x"], piece["h"], piece["w"]
    box = mask[y0 : y0 + h, x0 : x0 + w]
    if np.count_nonzero(box) == piece["pixels"]:
        # Nothing else is in the box.
        out = np.zeros_like(mask)
        out[y0 : y0 + h, x0 : x0 + w] = box
        return out
    for start in np.flatnonzero(box[0]):
        seen = np.zeros_like(box)
        seen[0, start] = True
        while True:
            grown = dilate(seen, 1) & box
            if (grown == seen).all():
                break
            seen = grown
        ys, xs = np.nonzero(seen)
        if len(ys) == piece["pixels"] and ys.max() == h - 1 and xs.min() == 0 and xs.max() == w - 1:
            out = np.zeros_like(mask)
            out[y0 : y0 + h, x0 : x0 + w] = seen
            return out
    return np.zeros_like(mask)


def content_extent(ink: np.ndarray, angle: float = 0.0, trim: float = 0.004) -> dict:
    """Width, height, centre and density of what is printed, along axes turned by angle; a share of trim of the ink goes at each end.

    Without ink it is the whole frame, with density 0.
    """
    h, w = ink.shape
    total = float(np.clip(ink, 0, None).sum(dtype=np.float64))
    if total <= 0:
        return {"width": float(w), "height": float(h), "x": w / 2, "y": h / 2, "angle": angle, "density": 0.0}
    c, s = math.cos(angle), math.sin(angle)
    corners = np.array([[0, 0], [w, 0], [0, h], [w, h]], float)
    us, vs = corners @ [c, s], corners @ [-s, c]
    ys, xs = np.nonzero(ink > 0)
    weight, px, py = ink[ys, xs].astype(np.float64), xs + 0.5, ys + 0.5

    def span(place: np.ndarray, low: float, high: float) -> tuple[int, int]:
        bins = np.bincount(np.floor(place - low).astype(int), weight, math.ceil(high - low) + 2)
        first = int(np.argmax(np.cumsum(bins) > total * trim)) if total * trim < bins.sum() else len(bins) - 1
        last = len(bins) - 1 - int(np.argmax(np.cumsum(bins[::-1]) > total * trim))
        return first, max(first, last) + 1

    (u0, u1), (v0, v1) = span(px * c + py * s, us.min(), us.max()), span(py * c - px * s, vs.min(), vs.max())
    u, v = us.min() + (u0 + u1) / 2, vs.min() + (v0 + v1) / 2
    return {"width": float(max(1, u1 - u0)), "height": float(max(1, v1 - v0)), "x": u * c - v * s, "y": u * s + v * c, "angle": angle, "density": total / (w * h)}


@functools.lru_cache(16)
def _weights(n: int, to: int) -> np.ndarray:
    """The matrix that takes n samples to `to`: means of covered parts when there are fewer, straight lines between centres when not. Not to be written to."""
    ratio, out = n / to, np.zeros((to, n))
    if ratio > 1:
        edge = np.arange(n)
        for k in range(to):
            part = np.minimum((k + 1) * ratio, edge + 1) - np.maximum(k * ratio, edge)
            part = np.clip(part, 0, None)
            out[k] = part / part.sum()
        return out
    at = np.clip((np.arange(to) + 0.5) * ratio - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    np.add.at(out, (np.arange(to), low), 1 - (at - low))
    np.add.at(out, (np.arange(to), np.minimum(n - 1, low + 1)), at - low)
    return out


@functools.lru_cache(16)
def _bands(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, share): the few samples of n that each of `to` is made of, and their weights; unused ones weigh 0. Not to be written to."""
    weights = _weights(n, to)
    first = np.argmax(weights > 0, axis=1)
    wide = int((n - np.argmax(weights[:, ::-1] > 0, axis=1) - first).max())
    at = first + np.arange(wide)[:, None]
    return np.minimum(at, n - 1), np.where(at < n, weights[np.arange(to), np.minimum(at, n - 1)], 0)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image at another size: area means for the side that gets shorter, linear for one that gets longer."""
    if (height, width) == image.shape:
        return image.copy()
    # Nearly all weights are 0. Down last, as rows are taken whole.
    at, share = _bands(image.shape[1], width)
    across = np.ascontiguousarray(image.T, np.float64)
    rows = sum(across.take(a, axis=0) * s[:, None] for a, s in zip(at, share, strict=True)).T.astype(np.float32)
    at, share = _bands(image.shape[0], height)
    down = np.ascontiguousarray(rows, np.float64)
    return sum(down.take(a, axis=0) * s[:, None] for a, s in zip(at, share, strict=True)).astype(np.float32)


def downscale(image: np.ndarray, longest: int) -> tuple[np.ndarray, float]:
    """An image whose longer side is at most longest, and the scale that its width really has."""
    h, w = image.shape
    if max(h, w) <= longest:
        return image.copy(), 1.0
    scale = longest / max(h, w)
    width, height = (max(1, math.floor(v * scale + 0.5)) for v in (w, h))
    return resize(image, width, height), width / w


def polarity(gray: np.ndarray, dpi: float, rect: Rect) -> str:
    """'light-on-dark' where a run's glyphs are lighter than its background, the median; glyphs are what differs from it by more than 0.19."""
    t, b, lft, r = clipped(tuple(v * dpi / 72 for v in rect), gray.shape)
    values = np.sort(gray[t:b, lft:r].ravel()) if b > t and r > lft else np.zeros(0)
    if not len(values):
        return "dark-on-light"
    ground = values[len(values) // 2]
    glyphs = values[np.abs(values - ground) > 0.19]
    return "light-on-dark" if len(glyphs) and glyphs.mean() > ground else "dark-on-light"


def printed_under(gray: np.ndarray, dpi: float, rect: Rect, share: float = 0.2) -> bool:
    """Whether a word's box (in points) is dark on the original already, by a share of its pixels: then nobody added it. gray is 0 to 1."""
    t, b, lft, r = clipped(tuple(v * dpi / 72 for v in rect), gray.shape)
    return b > t and r > lft and float((gray[t:b, lft:r] * 255 < 128).mean()) >= share


def best_template(glyph: np.ndarray, templates: Iterable[np.ndarray]) -> float:
    """The best correlation of a glyph with templates of its size; -1 without any."""
    return max((float(correlation(glyph, t)) for t in templates), default=-1.0)


# The ring of a segment test, from the top clockwise (x, y), and how many of it in a row make a corner.
RING = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]
ARC = 9


def peaks(scores: np.ndarray) -> np.ndarray:
    """Positive scores that no neighbour (3 x 3) exceeds; plateaus stay whole."""
    padded = np.pad(scores, 1, constant_values=-np.inf)
    h, w = scores.shape
    around = np.max([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy], 0)
    return (scores > 0) & (scores >= around)


@functools.cache
def _arcs() -> np.ndarray:
    """Whether ARC of 16 pixels in a row are set, for each set of them as bits. Not to be written to."""
    sets = np.arange(1 << 16)
    sets |= sets << 16
    return functools.reduce(np.bitwise_and, (sets >> k for k in range(ARC))) & 0xFFFF != 0


def corners(image: np.ndarray, threshold: float, border: int = 3) -> list[tuple[int, int, float]]:
    """(x, y, score) of corners: ARC pixels of the ring in a row all brighter or all darker by the threshold; the score sums what exceeds it, and only peaks stay."""
    h, w = image.shape
    border = max(3, border)
    if h <= 2 * border or w <= 2 * border:
        return []
    g = image.astype(np.float64)
    inner = g[border : h - border, border : w - border]
    high, low = inner + threshold, inner - threshold
    ring = [g[border + dy : h - border + dy, border + dx : w - border + dx] for dx, dy in RING]

    bright, dark = np.zeros((2, *inner.shape), np.uint16)
    for k, v in enumerate(ring):
        bright |= (v > high).astype(np.uint16) << k
        dark |= (v < low).astype(np.uint16) << k
    found = _arcs()[bright] | _arcs()[dark]
    at = np.stack([v[found] for v in ring])
    score = np.zeros(inner.shape)
    score[found] = np.maximum(np.clip(at - high[found], 0, None).sum(0), np.clip(low[found] - at, 0, None).sum(0))
    whole = np.zeros((h, w))
    whole[border : h - border, border : w - border] = score
    ys, xs = np.nonzero(peaks(whole))
    return [(int(x), int(y), float(whole[y, x])) for y, x in zip(ys, xs, strict=True)]
