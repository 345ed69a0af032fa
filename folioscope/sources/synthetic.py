"""Synthetic pages and scans with known ground truth, as a data source: a seeded form, and what a scanner makes of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.functions.geometry import Mulberry
from folioscope.functions.raster import box_blur, warp
from folioscope.workers import keep_freed


def form(seed: int, width: int = 425, height: int = 550) -> np.ndarray:
    """A gray page (0 to 1): header, text bars, a table of 5 by 4 and three boxes."""
    r, page = Mulberry(seed), np.ones((height, width), np.float32)
    page[20:36, 30 : 30 + int(width * 0.5)] = 0.1
    y = 60
    while y < height * 0.5:
        x = 30
        while x < width - 60:
            n = 12 + int(r.uniform() * 40)
            page[y : y + 6, x : min(width - 30, x + n)] = 0.15
            x += n + 6
        y += 14
    top, left = int(height * 0.55), 30
    for i in range(6):
        page[top + i * 20, left : left + 240] = 0.2
    for j in range(5):
        page[top : top + 101, left + j * 60] = 0.2
    for k in range(3):
        y, x = int(height * 0.8) + k * 24, 40
        page[[y, y + 14], x : x + 15] = 0.2
        page[y : y + 15, [x, x + 14]] = 0.2
    return page


def scanned(page: np.ndarray, seed: int, rotation: float = 0.0, scale: float = 1.0, shift: tuple[float, float] = (0.0, 0.0), noise: float = 0.0, light: float = 0.0, blur: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(scan, matrix from page to scan): turned about the centre, scaled, shifted, blurred, unevenly lit, with noise."""
    h, w = page.shape
    t, cx, cy = np.deg2rad(rotation), w / 2, h / 2
    c, s = scale * np.cos(t), scale * np.sin(t)
    m = np.array([[c, -s, cx - c * cx + s * cy + shift[0]], [s, c, cy - s * cx - c * cy + shift[1]], [0, 0, 1]])
    out = warp(page, np.linalg.inv(m), page.shape)
    out = box_blur(out, blur) if blur else out
    out = out * (1 - light * np.linspace(0, 1, w)[None, :])
    if noise:
        r = np.random.RandomState(seed)
        # The samples of three whole images, a strip of each at a time.
        grain = r.random_sample((h, w))
        for _ in range(2):
            for k in range(0, h, 64):
                grain[k : k + 64] += r.random_sample((min(64, h - k), w))
        grain -= 1.5
        grain *= noise
        out += grain
    return np.clip(out, 0, 1, out=out).astype(np.float32), m


def made(page: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(original, scan, matrix) of a page: gray bytes, and the matrix from page to scan."""
    r = Mulberry(seed * 1000 + page)
    original = form(seed * 1000 + page)
    scan, m = scanned(original, page, (r.uniform() - 0.5) * 4, 1.0, ((r.uniform() - 0.5) * 10, (r.uniform() - 0.5) * 10), 0.02, 0.1)
    return *(np.rint(g * 255).astype(np.uint8) for g in (original, scan)), m


class PageSource(DataSource):
    """spark.read.format("synthetic_pages").option("pages", n).option("seed", s): page, width, height, original and scan (bytes of gray), matrix."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_pages"

    def schema(self) -> str:
        return "page long, width int, height int, original binary, scan binary, matrix array<double>"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.pages, self.seed, self.parts = int(options.get("pages", 4)), int(options.get("seed", 1)), int(options.get("partitions", 2))

    def partitions(self):
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition):
        keep_freed()
        for page in range(partition.value, self.pages, self.parts):
            original, scan, m = made(page, self.seed)
            yield (page, original.shape[1], original.shape[0], original.tobytes(), scan.tobytes(), m.ravel().tolist())
