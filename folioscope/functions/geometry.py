"""Plane geometry: matrices, least-squares fits, robust fitting with a seeded generator."""

from __future__ import annotations

import numpy as np

IDENTITY = np.eye(3)


class Mulberry:
    """The 32-bit generator of that name: uniforms in [0, 1) and normals by the cosine branch of Box and Muller."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def uniform(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = (t ^ t >> 15) * (t | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    def normal(self) -> float:
        u = max(self.uniform(), np.finfo(float).tiny)
        return float(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * self.uniform()))


def apply(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ m.T
    return p[:, :2] / p[:, 2:]


def invert(m: np.ndarray) -> np.ndarray | None:
    """The inverse scaled to a last entry of 1 where that isn't 0; None if there is none."""
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    out = np.linalg.inv(m)
    return out / out[2, 2] if abs(out[2, 2]) > 1e-12 else out


def fit_similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Rotation, scale and shift by least squares, in closed form."""
    if len(source) < 2:
        return None
    s, t = source - source.mean(0), target - target.mean(0)
    spread = (s**2).sum()
    if spread < 1e-12:
        return None
    a, b = (s * t).sum() / spread, (s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum() / spread
    m = np.array([[a, -b, 0], [b, a, 0], [0, 0, 1.0]])
    m[:2, 2] = target.mean(0) - m[:2, :2] @ source.mean(0)
    return m


def fit_affine(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    if len(source) < 3:
        return None
    x = np.c_[source, np.ones(len(source))]
    if np.linalg.matrix_rank(x) < 3:
        return None
    return np.vstack([np.linalg.lstsq(x, target, rcond=None)[0].T, [0, 0, 1]])


def _normaliser(p: np.ndarray) -> np.ndarray | None:
    c = p.mean(0)
    d = np.sqrt(((p - c) ** 2).sum(1)).mean()
    if d < 1e-12:
        return None
    s = np.sqrt(2) / d
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def fit_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Direct linear transform on normalised points."""
    if len(source) < 4:
        return None
    n, k = _normaliser(source), _normaliser(target)
    if n is None or k is None:
        return None
    s, t = apply(n, source), apply(k, target)
    rows = []
    for (x, y), (u, v) in zip(s, t, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    m = np.linalg.inv(k) @ h @ n
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


MODELS = {"similarity": (2, fit_similarity), "affine": (3, fit_affine), "homography": (4, fit_homography)}


def plausible(m: np.ndarray, ratio: float = 8.0) -> bool:
    if not np.isfinite(m).all() or np.linalg.det(m[:2, :2]) <= 1e-9:
        return False
    norms = np.linalg.norm(m[:2, :2], axis=0)
    return bool(((norms >= 1 / ratio) & (norms <= ratio)).all())


def ransac(source: np.ndarray, target: np.ndarray, model: str = "similarity", limit: float = 3.0, rounds: int = 2000, sure: float = 0.995, seed: int = 0x5CA7F1):
    """(matrix, inliers) of the model that most points fit within limit, refitted once; None if there are too few points. Deterministic."""
    size, fit = MODELS[model]
    if len(source) < size:
        return None
    r, best, left, k = Mulberry(seed), None, rounds, 0
    while k < left:
        k += 1
        pick: list[int] = []
        while len(pick) < size:
            i = int(r.uniform() * len(source))
            if i not in pick:
                pick.append(i)
        m = fit(source[pick], target[pick])
        if m is None or not plausible(m):
            continue
        inside = np.sqrt(((apply(m, source) - target) ** 2).sum(1)) <= limit
        if best is None or inside.sum() > best[1].sum():
            best = (m, inside)
            share = inside.mean() ** size
            left = min(rounds, k if share >= 1 else int(np.ceil(np.log(1 - sure) / np.log(max(1e-12, 1 - share)))) if share > 0 else rounds)
    if best is None:
        return None
    again = fit(source[best[1]], target[best[1]])
    if again is not None and plausible(again):
        inside = np.sqrt(((apply(again, source) - target) ** 2).sum(1)) <= limit
        if inside.sum() >= best[1].sum():
            best = (again, inside)
    return best


def prefers(freer: float, simpler: float, more_freedom: bool, margin: float = 0.02) -> bool:
    """Whether a challenger's confidence beats the holder's: a freer model by more than the margin, one as free strictly."""
    return freer > simpler + (margin if more_freedom else 0.0)
