"""PNG images without other libraries: gray, gray with alpha, RGB and RGBA of 8 bits, not interlaced."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(image: np.ndarray, dpi: float | None = None, level: int = 6) -> bytes:
    """A PNG of height x width, or height x width x 2, 3 or 4 bytes. Rows are filtered by the difference to the row above, which suits pages."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or 0 in image.shape:
        raise ValueError("an image has bytes in two or three dimensions")
    h, w = image.shape[:2]
    kind = next((k for k, n in CHANNELS.items() if n == (1 if image.ndim == 2 else image.shape[2])), None)
    if kind is None:
        raise ValueError("an image has one to four channels")
    rows = image.reshape(h, -1)
    up = np.concatenate([rows[:1], rows[1:] - rows[:-1]])
    raw = np.concatenate([np.full((h, 1), 2, np.uint8), up], 1).tobytes()
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))]
    if dpi:
        per_metre = int(dpi / 0.0254 + 0.5)
        out.append(_chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)))
    return b"".join([*out, _chunk(b"IDAT", zlib.compress(raw, level)), _chunk(b"IEND", b"")])


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(name + body):
            raise ValueError(f"chunk {name!r} is damaged")
        yield name, body
        at += 12 + n


def metadata(data: bytes) -> dict:
    """width, height, channels, bits, interlaced and dpi (None if it isn't told), without decoding pixels."""
    out = None
    for name, body in _chunks(data):
        if name == b"IHDR":
            w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            out = {"width": w, "height": h, "channels": CHANNELS.get(kind, 1), "bits": bits, "interlaced": bool(interlaced), "palette": kind == 3, "dpi": None}
        elif name == b"pHYs" and out is not None and body[8] == 1:
            out["dpi"] = struct.unpack(">I", body[:4])[0] * 0.0254
        elif name == b"IDAT":
            break
    if out is None:
        raise ValueError("the image has no header")
    return out


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
    out, up = row.astype(int).tolist(), above.tolist()
    for k in range(len(out)):
        left, corner = (out[k - step], up[k - step]) if k >= step else (0, 0)
        if kind == 3:
            guess = (left + up[k]) // 2
        elif kind == 4:
            p = left + up[k] - corner
            a, b, c = abs(p - left), abs(p - up[k]), abs(p - corner)
            guess = left if a <= b and a <= c else up[k] if b <= c else corner
        else:
            raise ValueError(f"unknown filter {kind}")
        out[k] = (out[k] + guess) & 255
    return np.array(out, np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The image of a PNG that encode() could have made, with any row filters. Palettes, other depths and interlacing raise ValueError."""
    m = metadata(data)
    if m["bits"] != 8 or m["interlaced"] or m["palette"]:
        raise ValueError("only plain images of 8 bits are read")
    n = m["channels"]
    raw = np.frombuffer(zlib.decompress(b"".join(body for name, body in _chunks(data) if name == b"IDAT")), np.uint8)
    if len(raw) != m["height"] * (m["width"] * n + 1):
        raise ValueError("the image has another size than its header says")
    rows = raw.reshape(m["height"], -1)
    out = np.zeros((m["height"], m["width"] * n), np.uint8)
    above = np.zeros(m["width"] * n, np.uint8)
    for y, r in enumerate(rows):
        above = out[y] = _unfiltered(int(r[0]), r[1:], above, n)
    return out if n == 1 else out.reshape(m["height"], m["width"], n)
