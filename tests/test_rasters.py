"""Raster queries: whole pages, one for each row, and registration from the images."""

import time

import numpy as np
import pytest
from pyspark.sql.datasource import InputPartition

from folioscope.functions import ink as I
from folioscope.functions import raster as R
from folioscope.plans import rasters, registry
from folioscope.sources.synthetic import _Reader, form, scanned


@pytest.fixture
def made(spark, tmp_path):
    spark.createDataFrame([(i, "<html>") for i in range(6)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return lambda name: registry.queries()[name](spark, str(tmp_path)).collect()


@pytest.mark.parametrize("shape, radius", [((7, 9), 1), ((130, 5), 1), ((6, 8), 2), ((1, 3), 1)])
def test_despeckle_is_the_definition(shape, radius):
    image = np.random.RandomState(3).rand(*shape).astype(np.float32)
    want = np.empty_like(image)
    for y, x in np.ndindex(*shape):
        v = np.sort(image[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1], axis=None)
        want[y, x] = v[len(v) >> 1]
    assert (R.despeckle(image, radius) == want).all()


def test_a_page_for_every_row_and_whole_pages_levelled(made):
    for name in ("raster_ink", "raster_align", "raster_diff", "raster_level"):
        got = made(name)
        assert sorted(r.page for r in got) == list(range(6))
        if name == "raster_align":
            assert all(r.error < 2 and r.after > 0.9 > r.before for r in got)
        if name == "raster_diff":
            assert all((r.unexpected, r.missing) == (1, 0) and 15 < r.added_mm2 < 20 for r in got)
        if name == "raster_level":
            scans = {row[0]: np.frombuffer(row[4], np.uint8).reshape(row[2], row[1]) for row in _Reader({"pages": "6", "partitions": "1"}).read(InputPartition(0))}
            assert all(r.despeckled == pytest.approx(R.despeckle((scans[r.page] / 255).astype(np.float32)).mean(), abs=1e-6) for r in got)


def test_registration_doesnt_know_the_truth():
    page = form(5)
    scan, m = scanned(page, 5, 1.6, 1.0, (4.0, -3.0), 0.02, 0.1)
    assert R.corner_error(np.eye(3), m, page.shape) > 5
    assert R.corner_error(R.estimate_matrix(page, scan), m, page.shape) < 2
    assert R.corner_error(m, m, page.shape) == 0

def slow(f, *args):
    """CPU seconds of f, the least of five, in transforms of a page by numpy."""
    image = np.random.RandomState(1).rand(1024, 512)

    def least(g):
        took = []
        for _ in range(5):
            t = time.thread_time()
            g()
            took.append(time.thread_time() - t)
        return min(took)

    return least(lambda: f(*args)) / least(lambda: np.fft.fft2(image))


@pytest.fixture(scope="module")
def page():
    (row,) = _Reader({"pages": "1", "partitions": "1"}).read(InputPartition(0))
    original, scan = ((np.frombuffer(b, np.uint8).reshape(row[2], row[1]) / 255).astype(np.float32) for b in row[3:5])
    return original, scan, np.array(row[5]).reshape(3, 3)


def test_a_stroke_is_found_in_the_time_of_few_transforms(page):
    assert slow(rasters.stroke_found, *page) < 16


def test_warp_is_bilinear():
    r = np.random.RandomState(5)
    image = r.rand(9, 7).astype(np.float32)
    for m in (np.array([[0.9, 0.2, -2.5], [-0.2, 1.1, 1.5], [0, 0, 1]]), np.array([[0.9, 0.2, -2.5], [-0.2, 1.1, 1.5], [0.01, 0.02, 1]]), np.array([[1, 0, 1e9], [0, 1, 3.0], [0, 0, 1]])):
        got = R.warp(image, m, (40, 11), 0.7)
        for i, j in np.ndindex(40, 11):
            q = m @ [j + 0.5, i + 0.5, 1]
            x, y = q[:2] / q[2] - 0.5
            at = lambda v, u: float(image[v, u]) if 0 <= v < 9 and 0 <= u < 7 else 0.7
            a, b = int(np.floor(x)), int(np.floor(y))
            want = sum(at(b + k, a + h) * abs(1 - h - (x - a)) * abs(1 - k - (y - b)) for k in (0, 1) for h in (0, 1))
            assert got[i, j] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("shape, radius", [((7, 9), 1), ((13, 5), 3), ((1, 3), 2), ((6, 8), 20)])
def test_windows_are_clipped(shape, radius):
    image = np.random.RandomState(6).rand(*shape)
    windows = {(y, x): image[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1] for y, x in np.ndindex(*shape)}
    blurred, grown = R.box_blur(image, radius), R.dilate(image > 0.8, radius)
    assert all(blurred[k] == pytest.approx(v.mean()) and grown[k] == (v > 0.8).any() for k, v in windows.items())


def test_registration_takes_the_time_of_few_transforms(page):
    original, scan, _ = page
    assert slow(R.estimate_matrix, original, scan) < 12
    lean, ink = R.estimate_skew(R.binarize(R.ink_map(scan))), R.ink_map(original)
    assert (R.estimate_matrix(original, scan, lean, ink) == R.estimate_matrix(original, scan)).all()


def test_despeckling_takes_less_than_a_transform(page):
    assert slow(R.despeckle, page[1]) < 1


def test_pages_and_their_pieces_take_the_time_of_a_transform(page):
    mask = R.binarize(R.ink_map(page[1]))
    assert slow(R.components, mask) < 0.4
    assert slow(lambda: list(_Reader({"pages": "1", "partitions": "1"}).read(InputPartition(0)))) < 2


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_against_flooding(diagonal):
    for seed, share in ((1, 0.4), (2, 0.6), (3, 0.0), (4, 1.0)):
        mask, want = np.random.RandomState(seed).rand(17, 23) < share, []
        left = {(y, x) for y, x in zip(*map(list, np.nonzero(mask)), strict=True)}
        for k in sorted(left):
            if k in left:
                left.remove(k)
                seen = [k]
                for y, x in seen:
                    near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not (a and b)} & left
                    left -= near
                    seen += near
                ys, xs = zip(*seen, strict=True)
                want.append({"x": min(xs), "y": min(ys), "w": max(xs) - min(xs) + 1, "h": max(ys) - min(ys) + 1, "pixels": len(seen)})
        assert R.components(mask, diagonal) == want


@pytest.mark.parametrize("shape", [(30, 41), (1, 9), (25, 3)])
def test_profiles_by_running_sums_are_those_of_pixels(shape):
    h, w = shape
    mask = np.random.RandomState(8).rand(h, w) < 0.4
    sums = np.zeros((w + 1, h), int)
    sums[1:] = np.cumsum(mask, axis=1).T
    upto = np.concatenate([[0], np.cumsum(sums[-1])])
    y, x = np.nonzero(mask)
    for angle in (-12.0, -3.36, -0.04, 0.0, 0.2, 2.04, 12.0, 70.0):
        at, whole, falls = R._crossings(h, w, angle)
        got = np.abs(np.diff(sums.ravel()[at].sum(0) + (-upto[whole] if falls else upto[whole])))
        row, col = R._places(h, w, angle)
        want = np.bincount((row[y] - col[x]).astype(int))
        assert np.trim_zeros(got).tolist() == np.trim_zeros(want).tolist()


def test_skew_of_large_pages_is_that_of_tables(page, monkeypatch):
    mask = R.binarize(R.ink_map(page[1]))
    by_table = R.estimate_skew(mask)
    assert slow(R.estimate_skew, mask) < 0.45
    monkeypatch.setattr(R, "TABLED", 0)
    assert R.estimate_skew(mask) == by_table and abs(by_table) > 0.1


def test_registration_in_single_precision_is_that_in_double(page):
    original, scan, _ = page
    assert slow(R.estimate_matrix, original, scan) < 5

    def shift(a, b):
        h, w = 1024, 512
        f, g = (np.fft.fft2((v - v.mean()) * np.hanning(550)[:, None] * np.hanning(425), (h, w)) for v in (a.astype(float), b))
        cross = np.conj(f) * g
        r = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        y, x = np.unravel_index(int(np.argmax(r)), r.shape)
        part = lambda p, q, s: 0.5 * (p - s) / (p - 2 * q + s)
        dx, dy = x + part(r[y, x - 1], r[y, x], r[y, (x + 1) % w]), y + part(r[y - 1, x], r[y, x], r[(y + 1) % h, x])
        return (dx - w if dx > w / 2 else dx), (dy - h if dy > h / 2 else dy)

    t = np.deg2rad(R.estimate_skew(R.binarize(R.ink_map(scan))) - R.estimate_skew(R.binarize(R.ink_map(original))))
    h, w = original.shape
    c, s = np.cos(t), np.sin(t)
    m = np.array([[c, -s, w / 2 * (1 - c) + h / 2 * s], [s, c, h / 2 * (1 - c) - w / 2 * s], [0, 0, 1]])
    for _ in range(2):
        dx, dy = shift(original, R.warp(scan, m, original.shape))
        m = m @ np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1]])
    assert np.allclose(R.estimate_matrix(original, scan), m, rtol=0, atol=1e-5)


def test_warps_that_leave_the_image_a_little_or_far():
    image = np.random.RandomState(9).rand(20, 30)
    for dx in (-70.25, -40.25, -3.5, 0.0, 5.75, 60.5, 64.0, 90.0):
        want = np.full((20, 30), 0.7)
        for i, j in np.ndindex(20, 30):
            a = int(np.floor(j + dx))
            p, q = (image[i, k] if 0 <= k < 30 else 0.7 for k in (a, a + 1))
            want[i, j] = p + (q - p) * (j + dx - a)
        assert np.allclose(R.warp(image, np.array([[1, 0, dx], [0, 1, 0], [0, 0, 1]]), (20, 30), 0.7), want)


def test_pages_are_made_where_they_are_measured(spark, made):
    rows = {row[0]: row for row in _Reader({"pages": "6", "partitions": "1"}).read(InputPartition(0))}
    same = lambda original, scan, m, k: all((g.ravel() == (np.frombuffer(b, np.uint8) / 255).astype(np.float32)).all() for g, b in zip((original, scan), rows[k][3:5], strict=True)) and m.ravel().tolist() == rows[k][5]
    seen = rasters.per_page(spark.range(6).withColumnRenamed("id", "page"), lambda original, scan, m: (sum(same(original, scan, m, k) for k in rows),), "page long, n int").collect()
    assert sorted((r.page, r.n) for r in seen) == [(k, 1) for k in range(6)]


def test_a_stroke_is_found_in_the_time_of_six_transforms(page):
    assert slow(rasters.stroke_found, *page) < 5.5


@pytest.mark.parametrize("m", [[[0.99, 0.1, -20.5], [-0.1, 0.99, 12.25], [0, 0, 1]], [[1, 0, 300], [0, 1, 0], [0, 0, 1]], [[0.99, 0.1, -2], [-0.1, 0.99, 1], [0.001, 0, 1]]])
def test_warps_in_single_precision_are_those_in_double(m):
    image = np.random.RandomState(4).rand(90, 70).astype(np.float32)
    got = R.warp(image, np.array(m), (80, 75), 0.3, np.float32)
    assert got.dtype == np.float32 and np.abs(got - R.warp(image, np.array(m), (80, 75), 0.3)).max() < 2e-5


def test_corners_and_smaller_images_take_little_of_a_transform(page):
    small, _ = I.downscale(page[1], 200)
    assert slow(I.corners, small, 0.2) < 0.37 and slow(I.downscale, page[1], 200) < 0.22


@pytest.mark.parametrize("size", [(7, 5), (30, 20), (11, 90), (1, 1), (40, 31)])
def test_resizing_by_bands_is_that_by_all_weights(size):
    image = np.random.RandomState(3).rand(31, 23).astype(np.float32)
    want = I._weights(31, size[1]) @ image.astype(float) @ I._weights(23, size[0]).T
    assert np.allclose(I.resize(image, *size), want, atol=1e-6)


def test_a_piece_alone_in_its_box_is_the_box():
    ring = np.zeros((40, 120), bool)
    ring[3:9, 5:110] = True
    ring[20:30, 20:30] = True
    ring[22:28, 22:28] = False
    ring[24, 24] = True
    bar, frame, dot = R.components(ring)
    assert I.piece_mask(ring, bar).sum() == bar["pixels"] and I.piece_mask(ring, frame).sum() == frame["pixels"] and not I.piece_mask(ring, frame)[24, 24]
    assert slow(I.piece_mask, ring, bar) < 0.02


def test_a_peak_at_the_border_of_a_strip_is_found():
    image = np.random.RandomState(2).rand(300, 90)
    for dy in (-130, -128, -127, 0, 31, 127, 128, 129):
        moved = np.roll(image, (dy, 5), (0, 1))
        dx, got, _ = R.phase_correlate(image, moved)
        assert abs(dx - 5) < 0.2 and abs(got - dy) < 0.2
