"""Measures of ink, resizing, corners and linear systems against direct computations."""

import math
import zlib

import numpy as np
import pytest

from folioscope.functions import ink, numbers, png
from folioscope.functions.raster import dilate


def masks(seed=1, shape=(30, 40)):
    r = np.random.RandomState(seed)
    return ink.Masks(r.rand(*shape) < 0.1, r.rand(*shape) < 0.12, 1)


def test_probe_counts_pixels():
    m = masks()
    for rect in ((3.2, 4.9, 7.1, 6.0), (-5, -5, 100, 100), (50, 1, 3, 3), (1, 1, 0, 0)):
        got = ink.probe(m, rect, 72.0)
        want = [0, 0, 0]
        for y in range(max(0, math.floor(rect[1])), min(30, math.ceil(rect[1] + rect[3]))):
            for x in range(max(0, math.floor(rect[0])), min(40, math.ceil(rect[0] + rect[2]))):
                near = lambda a, y=y, x=x: a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any()
                want[0] += m.scan[y, x] and not near(m.original)
                want[1] += m.original[y, x] and not near(m.scan)
                want[2] += m.scan[y, x] and m.original[y, x]
        assert np.allclose([got[k] for k in ("added", "lost", "shared")], np.array(want) * (25.4 / 72) ** 2)
    with pytest.raises(ValueError):
        ink.Masks(np.zeros((2, 2)), np.zeros((2, 3)))


def test_region_report():
    m = masks(3)
    got = ink.region_report(m, (0, 0, 40, 30), 0.02)
    assert math.isclose(got["added"], m.added.mean()) and got["filled"] == (m.added.mean() >= 0.02) and got["score"] <= 1
    assert ink.region_report(m, (100, 0, 5, 5)) == {"original_ink": 0.0, "scan_ink": 0.0, "added": 0.0, "removed": 0.0, "filled": False, "score": 0.0}


def test_added_share_counts_a_pixel_once():
    blank = np.zeros((20, 20), bool)
    scan = blank.copy()
    scan[5:9, 5:15] = True
    m = ink.Masks(blank, scan, 1)
    box = {"x": 5, "y": 5, "w": 10, "h": 4, "pixels": 40}
    assert ink.added_share(box, [(5, 5, 5, 4), (7, 5, 3, 4)], m) == 0.5
    assert ink.added_share(box, [(0, 0, 20, 20)] * 2, m) == 1.0 and ink.added_share(box, [], m) == 0.0


def test_region_ink_leaves_out_rules_and_specks():
    a = np.zeros((60, 100), bool)
    a[50, 0:100] = True
    a[10:20, 30:40] = True
    a[12, 43:46] = True
    a[40, 5] = True
    a[30:32, 80:82] = True
    got = ink.region_ink(a, (0, 0, 100, 60), 4, 10)
    assert (got["pixels"], got["changes"], got["largest"], got["form_lines"]) == (103, 1, 103, 1)
    assert got["bounds"] == (30, 10, 16, 10) and got["edge_touch"] == 0.0 and math.isclose(got["fill"], 103 / 6000)
    edge = np.zeros((20, 20), bool)
    edge[0:6, 0:6] = True
    assert math.isclose(ink.region_ink(edge, (0, 0, 20, 20), 2, 1)["edge_touch"], 11 / 36)
    assert ink.region_ink(a, (200, 0, 5, 5), 4, 10)["pixels"] == 0


def test_content_extent():
    a = np.zeros((50, 80))
    a[10:30, 20:60] = 1
    got = ink.content_extent(a)
    assert (got["width"], got["height"], got["x"], got["y"]) == (40, 20, 40, 20) and math.isclose(got["density"], 800 / 4000)
    turned = ink.content_extent(a, math.pi / 2)
    assert abs(turned["width"] - 20) <= 1 and abs(turned["height"] - 40) <= 1 and abs(turned["x"] - 40) <= 1
    assert ink.content_extent(np.zeros((4, 6))) == {"width": 6.0, "height": 4.0, "x": 3.0, "y": 2.0, "angle": 0.0, "density": 0.0}
    speck = a.copy()
    speck[0, 0] = 1
    assert ink.content_extent(speck)["width"] == 40


def test_resize():
    r = np.random.RandomState(2)
    a = r.rand(12, 16).astype(np.float32)
    half = ink.resize(a, 8, 6)
    assert np.allclose(half, a.reshape(6, 2, 8, 2).mean((1, 3)), atol=1e-6)
    assert np.allclose(ink.resize(np.full((5, 7), 0.3, np.float32), 17, 3), 0.3, atol=1e-6)
    up = ink.resize(np.array([[0.0, 1.0]], np.float32), 4, 1)
    assert np.allclose(up, [[0, 0.25, 0.75, 1]])
    small, scale = ink.downscale(a, 8)
    assert small.shape == (6, 8) and scale == 0.5 and ink.downscale(a, 100)[1] == 1.0


def test_weights_of_a_size_are_made_once():
    assert ink._weights(550, 200) is ink._weights(550, 200)


def test_polarity():
    page = np.full((40, 40), 0.1)
    page[10:14, 10:20] = 0.9
    assert ink.polarity(page, 72, (5, 5, 20, 15)) == "light-on-dark" and ink.polarity(1 - page, 72, (5, 5, 20, 15)) == "dark-on-light"
    assert ink.polarity(page, 72, (100, 5, 2, 2)) == "dark-on-light" and ink.polarity(page, 72, (25, 25, 5, 5)) == "dark-on-light"


def test_corners_against_pixels():
    r = np.random.RandomState(7)
    image = dilate(r.rand(40, 50) < 0.02, 2).astype(float) * 0.8 + r.rand(40, 50) * 0.05
    t, want = 0.2, {}
    for y in range(3, 37):
        for x in range(3, 47):
            ring = [image[y + dy, x + dx] for dx, dy in ink.RING]
            over, under = [v - image[y, x] - t for v in ring], [image[y, x] - t - v for v in ring]
            runs = lambda d: any(all(d[(k + j) % 16] > 0 for j in range(ink.ARC)) for k in range(16))
            if runs(over) or runs(under):
                want[x, y] = max(sum(v for v in over if v > 0), sum(v for v in under if v > 0))
    peaks = {k: v for k, v in want.items() if all(want.get((k[0] + dx, k[1] + dy), 0) <= v for dx in (-1, 0, 1) for dy in (-1, 0, 1))}
    got = {(x, y): s for x, y, s in ink.corners(image, t)}
    assert got.keys() == peaks.keys() and peaks and all(math.isclose(got[k], peaks[k]) for k in peaks)
    assert ink.corners(np.zeros((5, 5)), 0.1) == []
    square = np.zeros((20, 20))
    square[6:14, 6:14] = 1
    assert len(ink.corners(square, 0.3)) >= 4


def test_linear_systems():
    r = np.random.RandomState(4)
    for n in (1, 2, 5, 9):
        a, b = r.normal(size=(n, n)), r.normal(size=n)
        assert np.allclose(a @ numbers.solve(a, b), b)
        s = a + a.T
        values, vectors = numbers.eigen(s)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, s) and np.allclose(vectors.T @ vectors, np.eye(n))
        v = numbers.smallest_vector(s)
        assert np.allclose(s @ v, values.min() * v)
    assert numbers.solve(np.ones((2, 2)), np.ones(2)) is None
    assert numbers.solve(np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([2.0, 3.0])).tolist() == [3.0, 2.0]


def test_printed_under_and_templates():
    page = np.ones((100, 100))
    page[10:12, 10:20] = 0.2
    assert ink.printed_under(page, 72, (10, 10, 10, 10)) and not ink.printed_under(page, 72, (10, 11, 10, 10)) and not ink.printed_under(page, 72, (200, 0, 5, 5))
    a = np.eye(5)
    assert math.isclose(ink.best_template(a, [a[::-1], a]), 1.0) and ink.best_template(a, []) == -1.0


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (6, 4, 2), (5, 9, 3), (3, 8, 4)])
def test_png(shape):
    image = np.random.RandomState(1).randint(0, 256, shape).astype(np.uint8)
    data = png.encode(image, 300)
    assert (png.decode(data) == image).all()
    m = png.metadata(data)
    assert (m["height"], m["width"], m["channels"]) == (*shape[:2], shape[2] if len(shape) > 2 else 1) and abs(m["dpi"] - 300) < 0.02
    # Every row filter, written by its definition.
    n, rows = m["channels"], image.reshape(shape[0], -1).astype(int)
    for kind in range(5):
        lines = []
        for y in range(shape[0]):
            line = [kind]
            for k in range(rows.shape[1]):
                left, up = rows[y, k - n] if k >= n else 0, rows[y - 1, k] if y else 0
                corner = rows[y - 1, k - n] if y and k >= n else 0
                near = min((left, up, corner), key=lambda v: (abs(left + up - corner - v), 0))
                line.append((rows[y, k] - [0, left, up, (left + up) // 2, near][kind]) % 256)
            lines.append(bytes(int(v) for v in line))
        made = data[:8] + data[8:33] + png._chunk(b"IDAT", zlib.compress(b"".join(lines))) + png._chunk(b"IEND", b"")
        assert (png.decode(made) == image).all(), kind
    for bad in (b"no", data[:-20], data[:40] + b"x" + data[41:]):
        with pytest.raises(ValueError):
            png.decode(bad)
