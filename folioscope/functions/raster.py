"""Page images as numpy arrays: ink, masks, components, levelling, warping and differences. Pages are rows; these run in Arrow functions, one page at a time."""

from __future__ import annotations

import functools

import numpy as np

MM_PER_INCH = 25.4


def to_gray(rgba: np.ndarray) -> np.ndarray:
    """Height x width x 4 bytes on white, as 0 to 1."""
    x = rgba.astype(np.float64)
    a = x[..., 3:] / 255
    return ((x[..., :3] * a + 255 * (1 - a)) @ np.array([0.299, 0.587, 0.114]) / 255).astype(np.float32)


def _between(s: np.ndarray, radius: int, out: np.ndarray) -> None:
    """Differences of running sums (with a row of zeros in front) over windows of 2 * radius + 1 rows that are clipped at the borders."""
    n = len(s) - 1
    if n <= 2 * radius:
        at = np.arange(n)
        np.subtract(s[np.minimum(at + radius + 1, n)], s[np.maximum(at - radius, 0)], out=out)
        return
    out[:radius] = s[radius + 1 : 2 * radius + 1]
    np.subtract(s[2 * radius + 1 :], s[: n - 2 * radius], out=out[radius : n - radius])
    np.subtract(s[n], s[n - 2 * radius : n - radius], out=out[n - radius :])


@functools.lru_cache(4)
def _window_sizes(h: int, w: int, radius: int) -> np.ndarray:
    """Pixels of each window. Not to be written to."""
    n = [np.minimum(np.arange(k) + radius + 1, k) - np.maximum(np.arange(k) - radius, 0) for k in (h, w)]
    return (n[0][:, None] * n[1][None, :]).astype(float)


def _summed(sums: np.ndarray) -> None:
    """Running sums of rows, but for the first, which is 0; row by row is faster than cumsum."""
    for above, row in zip(sums[1:], sums[2:], strict=False):
        row += above


def box_blur(image: np.ndarray, radius: int) -> np.ndarray:
    """Means of windows that are clipped at the borders, by running sums down and then across."""
    h, w = image.shape
    down, across = np.empty((h + 1, w)), np.empty((w + 1, h))
    if not h or not w:
        return np.zeros((h, w))
    down[0], across[0] = 0, 0
    down[1:] = image
    _summed(down)
    _between(down, radius, across[1:].T)
    _summed(across)
    out = np.empty((w, h))
    _between(across, radius, out)
    return np.divide(out.T, _window_sizes(h, w, radius), order="C")


def ink_map(gray: np.ndarray, floor: float = 0.06) -> np.ndarray:
    """How much darker each pixel is than its surroundings: one less its share of the local paper; little is none."""
    ink = box_blur(gray, max(4, min(gray.shape) // 16))
    # A strip at a time stays in the cache.
    for k in range(0, len(ink), 64):
        part = ink[k : k + 64]
        np.maximum(part, 1e-6, out=part)
        np.divide(gray[k : k + 64], part, out=part)
        np.subtract(1, part, out=part)
        np.copyto(part, 0, where=part < floor)
        np.clip(part, 0, 1, out=part)
    return ink


def otsu(values: np.ndarray) -> float:
    """The upper end of the darker class among 256 bins of 0 to 1; the first of equally good ones."""
    # Blank paper is the first bin as it is; what isn't below 0 is cut off to its floor.
    values = values.ravel()
    inked = values[values != 0]
    at = np.clip(inked, 0, 1, dtype=np.result_type(values, np.float32))
    at *= 255
    at += 0.5
    n = np.bincount(at.astype(int), minlength=256).astype(float)
    n[0] += len(values) - len(inked)
    below, s = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (s / below - (s[-1] - s) / above) ** 2
    between[~np.isfinite(between)] = -1
    return float(np.argmax(between)) / 255


def binarize(image: np.ndarray, threshold: float | None = None, floor: float = 0.12) -> np.ndarray:
    return image > max(otsu(image) if threshold is None else threshold, floor)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """By a square."""
    if radius <= 0:
        return mask.copy()
    return _spread(_spread(mask.astype(bool), radius).T, radius).T


def _spread(mask: np.ndarray, radius: int) -> np.ndarray:
    """Each row or-ed with those up to radius above and below, in steps that double the reach."""
    n = len(mask)
    wide = np.zeros((n + 2 * radius, *mask.shape[1:]), bool)
    wide[radius : radius + n] = mask
    side, reach = 2 * radius + 1, 1
    # Row i of wide holds the rows i to i + reach - 1.
    while reach < side:
        step = min(reach, side - reach)
        wide = wide[:-step] | wide[step:]
        reach += step
    return wide


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~mask, radius)


def components(mask: np.ndarray, diagonal: bool = True) -> list[dict]:
    """Connected pixels by runs of rows and union-find, in order of their first pixel: x, y, w, h and pixels of each."""
    h, w = mask.shape
    # Runs of all rows at once, as no row's end touches the next one's start.
    framed = np.zeros((h, w + 2), np.int8)
    framed[:, 1 : w + 1] = mask
    d = np.diff(framed.ravel())
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    if not len(starts):
        return []
    y, a = np.divmod(starts, w + 2)
    b = ends - y * (w + 2)
    reach, pitch = int(diagonal), w + 4
    # The runs of the row before that end behind a run's start and start before its end.
    row = (y - 1) * pitch
    low = np.searchsorted(y * pitch + b, row + a - reach, "right")
    high = np.searchsorted(y * pitch + a, row + b + reach, "left")
    many = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(y)), many)
    above = np.arange(len(below)) - np.repeat(np.cumsum(many) - many - low, many)

    up = list(range(len(y)))
    for p, q in zip(below.tolist(), above.tolist(), strict=True):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        while up[q] != q:
            up[q] = up[up[q]]
            q = up[q]
        if p < q:
            up[q] = p
        else:
            up[p] = q
    # A run never hangs on a later one, so a run's root is known before the run.
    for i, k in enumerate(up):
        up[i] = up[k]
    root = np.array(up)
    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.diff(root[order], prepend=-1))
    left, right = np.minimum.reduceat(a[order], first), np.maximum.reduceat(b[order], first)
    top, bottom = np.minimum.reduceat(y[order], first), np.maximum.reduceat(y[order], first) + 1
    pixels = np.add.reduceat((b - a)[order], first)
    return [{"x": x, "y": t, "w": r - x, "h": u - t, "pixels": n} for x, t, r, u, n in zip(left.tolist(), top.tolist(), right.tolist(), bottom.tolist(), pixels.tolist(), strict=True)]


def merge_boxes(boxes: list[dict], gap: int) -> list[dict]:
    """Boxes within gap of each other joined until none is left."""
    left = [dict(b, parts=b.get("parts", 1)) for b in boxes]
    done = False
    while not done:
        done, out = True, []
        for b in left:
            for o in out:
                if b["x"] <= o["x"] + o["w"] + gap and o["x"] <= b["x"] + b["w"] + gap and b["y"] <= o["y"] + o["h"] + gap and o["y"] <= b["y"] + b["h"] + gap:
                    x, y = min(o["x"], b["x"]), min(o["y"], b["y"])
                    o.update(w=max(o["x"] + o["w"], b["x"] + b["w"]) - x, h=max(o["y"] + o["h"], b["y"] + b["h"]) - y, x=x, y=y, pixels=o["pixels"] + b["pixels"], parts=o["parts"] + b["parts"])
                    done = False
                    break
            else:
                out.append(b)
        left = out
    return left


def despeckle(image: np.ndarray, radius: int = 1) -> np.ndarray:
    """Medians of windows clipped at the borders; of an even number the upper middle."""
    if radius == 1 and min(image.shape) > 2 and not np.isnan(image).any():
        return _despeckle_three(image)
    return _despeckle(image, radius)


def _despeckle_three(image: np.ndarray) -> np.ndarray:
    """Windows of 3 x 3: each column of three is put in order once, for the three windows that it is in."""
    out = np.empty_like(image)
    low, high = np.minimum(image[:-2], image[1:-1]), np.maximum(image[:-2], image[1:-1])
    middle = np.maximum(low, np.minimum(high, image[2:]))
    low, high = np.minimum(low, image[2:]), np.maximum(high, image[2:])

    def median(x, y, z):
        return np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))

    three = lambda v: (v[:, :-2], v[:, 1:-1], v[:, 2:])
    (a, b, c), (d, e, f) = three(low), three(high)
    out[1:-1, 1:-1] = median(np.maximum(np.maximum(a, b), c), median(*three(middle)), np.minimum(np.minimum(d, e), f))
    out[0], out[-1] = _despeckle(image[:2], 1)[0], _despeckle(image[-2:], 1)[1]
    out[:, 0], out[:, -1] = _despeckle(image[:, :2], 1)[:, 0], _despeckle(image[:, -2:], 1)[:, 1]
    return out


def _despeckle(image: np.ndarray, radius: int) -> np.ndarray:
    h, w = image.shape
    side = 2 * radius + 1
    out = np.empty_like(image)
    wide = np.pad(image.astype(np.float64), radius, constant_values=np.inf)
    across = np.minimum(np.arange(w) + radius + 1, w) - np.maximum(np.arange(w) - radius, 0)
    # A strip of rows at a time; what lies outside the image sorts behind all that counts.
    for y in range(0, h, 64):
        n = min(64, h - y)
        windows = np.lib.stride_tricks.sliding_window_view(wide[y : y + n + 2 * radius], (side, side)).reshape(n, w, side * side)
        rows = np.arange(y, y + n)
        down = np.minimum(rows + radius + 1, h) - np.maximum(rows - radius, 0)
        middle = down[:, None] * across[None, :] >> 1
        out[y : y + n] = np.take_along_axis(np.sort(windows, axis=2), middle[:, :, None], 2)[:, :, 0]
    return out


def noise_sigma(gray: np.ndarray) -> float:
    """Immerkaer's estimate: mean absolute Laplacian difference."""
    g = gray.astype(np.float64)
    if min(g.shape) < 3:
        return 0.0
    down = g[:-2] - 2 * g[1:-1] + g[2:]
    lap = down[:, :-2] - 2 * down[:, 1:-1] + down[:, 2:]
    return float(np.abs(lap).mean() * np.sqrt(np.pi / 2) / 6)


def contrast_points(ratio: np.ndarray) -> tuple[float, float]:
    """1 % and 99 % points of paper ratios in 256 bins over 0 to 1.5, within 0 to 0.4 and 0.7 to 1.1."""
    n = np.bincount(np.clip((ratio.ravel() / 1.5 * 255), 0, 255).astype(int), minlength=256).cumsum()
    at = lambda s: float(np.searchsorted(n, s * n[-1])) / 255 * 1.5
    return min(0.4, max(0.0, at(0.01))), min(1.1, max(0.7, at(0.99)))


def level(gray: np.ndarray) -> np.ndarray:
    """Evens out the light: pixels by their local paper, stretched between the contrast points."""
    ratio = gray / np.maximum(box_blur(gray, max(4, min(gray.shape) // 16)), 1e-6)
    black, white = contrast_points(ratio)
    return np.clip((ratio - black) / (white - black), 0, 1)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's; 0 where a side doesn't vary."""
    x, y = a.ravel() - a.mean(), b.ravel() - b.mean()
    d = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / d) if d > 1e-12 else 0.0


def iou(a: np.ndarray, b: np.ndarray) -> float:
    union = np.count_nonzero(a | b)
    return np.count_nonzero(a & b) / union if union else 0.0


def _padded(shape: tuple[int, int]) -> tuple[int, int]:
    return tuple(1 << (n - 1).bit_length() for n in shape)


@functools.lru_cache(4)
def _hann(shape: tuple[int, int]) -> np.ndarray:
    """A Hann window in single precision, times what forward transforms divide by. Not to be written to."""
    h, w = _padded(shape)
    return (np.hanning(shape[0])[:, None] * np.hanning(shape[1])[None, :] * (h * w)).astype(np.float32)


def _spectrum(image: np.ndarray) -> np.ndarray:
    """The transform of an image under a Hann window, padded to powers of two, in single precision: only phases and a peak are read from it.

    Only scaled transforms run in single precision in numpy, and padding is faster than having it padded.
    """
    (tall, wide), (h, w) = image.shape, _padded(image.shape)
    hann, mean = _hann(image.shape), float(image.mean())
    down = np.empty((w // 2 + 1, h), np.complex64)
    down[:, tall:] = 0
    window = np.zeros((64, w), np.float32)
    # Across first, a strip at a time, then down; the rest of the padding below is zeros that need no transform across.
    for k in range(0, tall, 64):
        part = window[: min(64, tall - k)]
        np.subtract(image[k : k + 64], mean, out=part[:, :wide], casting="same_kind")
        part[:, :wide] *= hann[k : k + 64]
        down[:, k : k + len(part)] = np.fft.rfft(part, axis=1, norm="forward").T
    return np.fft.fft(down, axis=1, norm="forward", out=down)


def _shift(f: np.ndarray, g: np.ndarray, shape: tuple[int, int]) -> tuple[float, float, float]:
    """(dx, dy, peak) of two spectra of images of that shape, the first one conjugated."""
    h, w = _padded(shape)
    down = np.empty((h, len(g)), np.complex64)
    # Strips stay in the cache.
    for k in range(0, len(g), 32):
        cross = f[k : k + 32] * g[k : k + 32]
        size = np.abs(cross)
        np.maximum(size, 1e-12, out=size)
        cross *= np.reciprocal(size, out=size)
        down[:, k : k + 32] = np.fft.ifft(cross, axis=1, out=cross).T
    best, y, x = -np.inf, 0, 0
    for k in range(0, h, 128):
        r = np.fft.irfft(down[k : k + 128], w, axis=1)
        at = int(np.argmax(r))
        if r.flat[at] > best:
            best, y, x = r.flat[at], k + at // w, at % w
    above, row, below = np.fft.irfft(down[[y - 1, y, (y + 1) % h]], w, axis=1)

    def part(*three):
        low, mid, high = map(float, three)
        d = low - 2 * mid + high
        return 0.0 if abs(d) < 1e-12 else 0.5 * (low - high) / d

    dy = y + part(above[x], row[x], below[x])
    dx = x + part(row[x - 1], row[x], row[(x + 1) % w])
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), float(row[x])


def phase_correlate(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, peak) that moves a onto b, by Hann-windowed phase correlation with a parabola at the peak."""
    if a.shape != b.shape:
        raise ValueError("the images differ in size")
    return _shift(np.conj(_spectrum(a)), _spectrum(b), a.shape)


#: Pages of up to so many pixels have tables of where rows cross profiles: at most 256 of them, of 0.1 MB at 3 degrees and 0.5 MB at 12.
TABLED = 1 << 18


def _places(h: int, w: int, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """The bin of the profile at an angle that a row has at column 0, before it is cut off to its floor, and how much each column takes off.

    Moved by whole rows so that none is below 0 (up to 90 degrees) and cutting off is the floor; empty bins in front add nothing.
    """
    t = np.deg2rad(angle)
    return np.arange(h) * np.cos(t) + np.ceil((w + 1) * abs(np.sin(t))), np.arange(w).astype(float) * np.sin(t)


@functools.lru_cache(256)
def _crossings(h: int, w: int, angle: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(at, whole, falls): for each bin limit of the profile (across), the places in a table of w + 1 running sums of h rows where rows cross it, and how many rows are first.

    If bins fall along a row, a crossing row's first pixels lie above the limit, with all of the rows after the first ones;
    if not, they lie below it, with all of the first rows. Places that aren't needed are 0, where sums begin.
    """
    row, col = _places(h, w, angle)
    falls = np.deg2rad(angle) > 0
    bins = (row[:, None] - col[None, :]).astype(np.intp)
    low = int(bins.min())
    many = int(bins.max()) - low + 1
    n = np.bincount((bins - low + many * np.arange(h)[:, None]).ravel(), minlength=h * many).reshape(h, many)
    sums = np.zeros((h, many + 1), np.intp)
    np.cumsum(n, axis=1, out=sums[:, 1:])
    if falls:
        sums = w - sums
    whole = np.count_nonzero(sums < w if falls else sums == w, axis=0)
    limit, y = np.nonzero(((sums > 0) & (sums < w)).T)
    first = np.searchsorted(limit, np.arange(many + 1))
    k = np.arange(len(limit)) - first[limit]
    at = np.zeros((int(k.max(initial=-1)) + 1, many + 1), np.intp)
    at[k, limit] = sums[y, limit] * h + y
    return at, whole, falls


def estimate_skew(mask: np.ndarray, most: float = 12.0) -> float:
    """Degrees by which rows of ink lean: the angle whose profile is sharpest, searched by whole degrees, then finer.

    A profile counts the ink in rows one pixel high. Bins change along a row at few places, so running sums there give it, with every pixel.
    """
    h, w = mask.shape
    if not mask.any():
        return 0.0

    if mask.size <= TABLED:
        sums = np.zeros((w + 1, h), np.int32)
        sums[1:] = mask.T
        _summed(sums)
        upto, flat = np.concatenate([[0], np.cumsum(sums[-1])]).astype(float), sums.ravel()

        def profile(angle: float) -> np.ndarray:
            at, whole, falls = _crossings(h, w, angle)
            n = np.add.reduce(flat.take(at, mode="clip"), axis=0, dtype=np.int32)
            first = upto.take(whole)
            n = n - first if falls else n + first
            return n[1:] - n[:-1]
    else:
        x, many = np.nonzero(mask)[1], np.count_nonzero(mask, axis=1)

        def profile(angle: float) -> np.ndarray:
            row, col = _places(h, w, angle)
            p = np.repeat(row, many)
            p -= col.take(x)
            return np.bincount(p.astype(int))

    def sharp(angle: float) -> float:
        n = profile(angle).astype(float, copy=False)
        return float(n @ n)

    best, step = 0.0, most
    for step, around in ((1.0, most), (0.2, 1.0), (0.04, 0.2)):
        angles = best + np.arange(-round(around / step), round(around / step) + 1) * step
        best = float(angles[int(np.argmax([sharp(float(a)) for a in angles]))])
    return best


def warp(image: np.ndarray, matrix: np.ndarray, shape: tuple[int, int], fill: float = 1.0, kind: type = np.float64) -> np.ndarray:
    """Bilinear sampling at pixel centres: output pixel p shows image at matrix * p. kind: the precision of the values."""
    h, w = shape
    m = np.asarray(matrix, float)
    flat_plane = not m[2, :2].any() and m[2, 2] == 1
    # A frame: whatever lies outside is moved there, so that every place has four neighbours. Where little does, the frame is as wide as that, and nothing is moved.
    far = 0.0
    if flat_plane:
        x, y = m[:2] @ np.array([[0, w, 0, w], [0, 0, h, h], [1, 1, 1, 1]], float)
        far = max(0.0, -x.min(), -y.min(), x.max() - image.shape[1], y.max() - image.shape[0])
    moved = not flat_plane or not far < 64
    edge = 2 if moved else 2 + int(far)
    wide = image.shape[1] + 2 * edge
    framed = np.full((image.shape[0] + 2 * edge, wide), fill, kind)
    framed[edge:-edge, edge:-edge] = image
    flat = framed.ravel()
    xs = np.arange(w) + 0.5
    out = np.empty((h, w), kind)
    # In single precision, places are whole numbers of parts of a pixel: at least 4096 of them.
    bits = 30 - max(framed.shape).bit_length()
    fixed = kind != np.float64 and not moved and bits >= 12
    if fixed:
        ys = np.arange(h)[:, None] + 0.5
        across = [np.rint(m[k, 0] * xs * (1 << bits)).astype(np.int32) for k in range(2)]
        down = [np.rint((m[k, 1] * ys + (m[k, 2] + edge - 0.5)) * (1 << bits)).astype(np.int32) for k in range(2)]
    # A strip of rows at a time stays in the cache.
    for top in range(0, h, 32):
        ys = np.arange(top, min(h, top + 32))[:, None] + 0.5
        if fixed:
            x, y = (a + b[top : top + 32] for a, b in zip(across, down, strict=True))
            x0, y0 = x >> bits, y >> bits
            x &= (1 << bits) - 1
            y &= (1 << bits) - 1
            x, y = x.astype(kind), y.astype(kind)
            x *= kind(2.0**-bits)
            y *= kind(2.0**-bits)
        else:
            if flat_plane:
                x, y = (m[k, 0] * xs[None, :] + (m[k, 1] * ys + m[k, 2] + (edge - 0.5)) for k in range(2))
            else:
                x, y, z = (m[k, 0] * xs[None, :] + (m[k, 1] * ys + m[k, 2]) for k in range(3))
                x /= z
                y /= z
                x += edge - 0.5
                y += edge - 0.5
            x0, y0 = np.floor(x), np.floor(y)
            x, y = (np.subtract(v, v0, out=v).astype(kind, copy=False) for v, v0 in ((x, x0), (y, y0)))
        if moved:
            np.clip(x0, edge - 2, image.shape[1] + edge, out=x0)
            np.clip(y0, edge - 2, image.shape[0] + edge, out=y0)
        y0 *= wide
        y0 += x0
        at = y0.astype(np.intp)
        rows = []
        for k in (0, wide):
            a, b = flat[k:].take(at, mode="clip"), flat[k + 1 :].take(at, mode="clip")
            b -= a
            b *= x
            a += b
            rows.append(a)
        a, b = rows
        b -= a
        b *= y
        np.add(a, b, out=out[top : top + len(ys)])
    return out


def estimate_matrix(original: np.ndarray, scan: np.ndarray, lean: float | None = None, ink: np.ndarray | None = None, mask: np.ndarray | None = None) -> np.ndarray:
    """The matrix from page to scan, a turn about the centre and a shift, from the images alone: the difference of their skews, then phase correlation.

    lean: the scan's skew, ink: the page's ink map, mask: its ink, where they are known already.
    """
    h, w = original.shape
    if mask is None:
        mask = binarize(ink_map(original) if ink is None else ink)
    skew = (estimate_skew(binarize(ink_map(scan))) if lean is None else lean) - estimate_skew(mask)
    t, cx, cy = np.deg2rad(skew), w / 2, h / 2
    c, s = np.cos(t), np.sin(t)
    m = np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1]])
    page = _spectrum(original)
    np.conj(page, out=page)
    for _ in range(2):
        dx, dy, _ = _shift(page, _spectrum(warp(scan, m, original.shape, kind=np.float32)), original.shape)
        m = m @ np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1]])
    return m


def corner_error(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> float:
    """The largest distance in pixels between where two matrices put the corners of an image."""
    h, w = shape
    p, q = (m @ np.array([[0, w, 0, w], [0, 0, h, h], [1, 1, 1, 1]]) for m in (a, b))
    return float(np.hypot(*(p[:2] / p[2] - q[:2] / q[2])).max())


def diff_page(original: np.ndarray, scanned: np.ndarray, dpi: float = 150.0, tolerance: int = 2, min_change: float = 1.0, min_missing: float = 4.0, gap_mm: float = 3.0, most: int = 50, mask: np.ndarray | None = None) -> dict:
    """Ink that was added to or is missing from a page (gray, registered): boxes with their ink in mm2, the largest first.

    Specks under two pixels are dropped, boxes within the gap are merged, then small areas go. Missing ink must be gone from a
    fainter reading of the scan as well. mask: the page's ink, where it is known already.
    """
    if original.shape != scanned.shape:
        raise ValueError("the pages differ in size")
    b = ink_map(scanned)
    dark = otsu(b)
    mask_a, mask_b = binarize(ink_map(original)) if mask is None else mask, binarize(b, dark)
    faint = b > 0.25 * max(dark, 0.12)
    mm2 = (MM_PER_INCH / dpi) ** 2
    gap = int(np.floor(gap_mm * dpi / MM_PER_INCH + 0.5))

    def boxes(mask: np.ndarray, least: float) -> list[dict]:
        found = merge_boxes([c for c in components(mask) if c["pixels"] >= 2], gap)
        return sorted((dict(c, mm2=c["pixels"] * mm2) for c in found if c["pixels"] * mm2 >= least), key=lambda c: -c["pixels"])

    added = boxes(mask_b & ~dilate(mask_a, tolerance), min_change)
    missing = boxes(mask_a & ~dilate(faint, tolerance), min_missing)
    return {"unexpected": added[:most], "missing": missing[:most], "truncated": len(added) > most or len(missing) > most}


def checkbox_state(ink: np.ndarray, dpi: float, inset: float = 0.2, tick_mm2: float = 0.6, solid: float = 0.5) -> str:
    """'struck', 'ticked' or 'empty' from a box's ink mask."""
    h, w = ink.shape
    y, x = int(h * inset), int(w * inset)
    inner = ink[y : h - y, x : w - x]
    left = sum(c["pixels"] for c in components(inner) if c["pixels"] >= 2)
    core = erode(inner, max(1, round(0.4 * dpi / MM_PER_INCH)))
    if inner.size and dilate(core, max(1, round(0.4 * dpi / MM_PER_INCH)))[inner].sum() >= solid * inner.size:
        return "struck"
    return "ticked" if left * (MM_PER_INCH / dpi) ** 2 >= tick_mm2 else "empty"
