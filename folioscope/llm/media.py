"""MPEG audio columns: find and check frames, read tags and variable-bitrate tables, keep exact durations and frame seek offsets.

A stream is parsed without decoding sound. Stored payloads lie where decoders skip: every frame's side information says that no
main data is used, so the rest of the frame is ancillary data, and each frame carries whole units of 192 payload bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table, text_or_empty, written

UNIT = 192

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version class and layer, Hz by version.
KBPS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {10: [44100, 48000, 32000], 20: [22050, 24000, 16000], 25: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    version: int  # 10, 20 or 25: ten times the MPEG version
    layer: int
    crc: bool
    kbps: int
    rate: int
    mode: int  # 3: mono
    mode_ext: int
    length: int  # bytes of the frame with its header
    samples: int
    side: int  # bytes of side information that the checksum covers in layer III


def parse_header(word: int) -> Header | None:
    """The frame header in 32 bits, or None if they are none. Free-format frames, whose length isn't in the header, count as none."""
    if word >> 21 != 0x7FF:
        return None
    version = {3: 10, 2: 20, 0: 25}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    bit, freq = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or bit in (0, 15) or freq == 3 or word & 3 == 2:
        return None
    kbps, rate, pad = KBPS[1 if version == 10 else 2, layer][bit], RATES[version][freq], word >> 9 & 1
    mono = word >> 6 & 3 == 3
    if layer == 1:
        length, samples = (12 * kbps * 1000 // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 10 else 1152
        length = samples // 8 * kbps * 1000 // rate + pad
    side = ((17 if mono else 32) if version == 10 else (9 if mono else 17)) if layer == 3 else 0
    return Header(version, layer, not word >> 16 & 1, kbps, rate, word >> 6 & 3, word >> 4 & 3, length, samples, side)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = (out << 1 ^ np.where(out & 0x8000, 0x8005, 0)) & 0xFFFF
    return out


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG's CRC-16 (polynomial 8005, all ones at first) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[crc >> 8 ^ rows[:, k]]
    return crc


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    channels: int = 0
    version: int = 0
    layer: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    min_kbps: int = 0
    max_kbps: int = 0
    checked: int = 0
    crc_errors: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    delay: int = 0
    padding: int = 0

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that holds a sample."""
        if not 0 <= sample < self.samples:
            raise IndexError(sample)
        return self.offsets[sample * self.frames // self.samples]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the ID3v2 tag at the start (0: none) and its text frames; TXXX by description. Damaged frames end the reading."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] > 4 or data[3] < 2 or any(x & 0x80 for x in data[6:10]):
        return 0, {}
    version, size = data[3], _synchsafe(data[6:10])
    end, at, tags = min(len(data), 10 + size), 10, {}
    if version > 2 and data[5] & 0x40 and at + 4 <= end:
        at += _synchsafe(data[10:14]) if version == 4 else 4 + int.from_bytes(data[10:14], "big")
    wide = 10 if version > 2 else 6
    while at + wide <= end and data[at]:
        name = data[at : at + (4 if version > 2 else 3)].decode("latin-1")
        n = _synchsafe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8] if version == 3 else data[at + 3 : at + 6], "big")
        body = data[at + wide : min(end, at + wide + n)]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            parts = body[1:].decode(code, "replace").rstrip("\0").split("\0", 1)
            tags[parts[0] if name in ("TXXX", "TXX") and len(parts) > 1 else name] = parts[-1]
        at += wide + n
    return 10 + size + (10 if version == 4 and data[5] & 0x10 else 0), tags


def _vbr_table(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Reads a Xing, Info or VBRI table in the frame at at; whether there is one."""
    x = at + 4 + 2 * h.crc + h.side
    frame = data[at : at + h.length]
    if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= at + h.length:
        s.table = data[x : x + 4].decode()
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        if flags & 1:
            s.table_frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 2:
            s.table_bytes, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 4:
            s.toc, x = list(data[x : x + 100]), x + 100
        x += 4 * bool(flags & 8)
        if data[x : x + 4] in (b"LAME", b"Lavf", b"Lavc") and x + 24 <= at + h.length:
            d = int.from_bytes(data[x + 21 : x + 24], "big")
            s.delay, s.padding = d >> 12, d & 0xFFF
        return True
    v = frame[36:62]
    if v[:4] == b"VBRI" and len(v) == 26:
        s.table, s.table_bytes, s.table_frames = "VBRI", int.from_bytes(v[10:14], "big"), int.from_bytes(v[14:18], "big")
        entries, scale, width = struct.unpack(">HHH", v[18:24])
        body = frame[62 : 62 + entries * width]
        s.toc = [int.from_bytes(body[k : k + width], "big") * scale for k in range(0, len(body), max(1, width))]
        return True
    return False


def parse(data: bytes) -> Stream:
    """Everything that can be known of a stream without decoding it; bytes that are no MPEG audio give a stream without frames.

    A header counts where the frame it opens is followed by another header of the same kind, by a closing tag or by the end; else the
    search goes on at the next byte, so junk and damaged frames are skipped and counted. A table frame isn't part of the duration.
    """
    s = Stream()
    at, s.tags = read_id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("v1.title", 3, 33), ("v1.artist", 33, 63), ("v1.album", 63, 93), ("v1.year", 93, 97)):
            s.tags[name] = data[end + a : end + b].split(b"\0")[0].decode("latin-1").rstrip()
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        if size <= end - at:
            end -= size + 32 * bool(data[end - 9] & 0x80)
    memo: dict[int, Header | None] = {}

    def header(i: int) -> Header | None:
        if i + 4 > end:
            return None
        w = int.from_bytes(data[i : i + 4], "big")
        if w not in memo:
            memo[w] = parse_header(w)
        return memo[w]

    first: Header | None = None
    synced = False
    headers = []
    while at < end:
        h = header(at)
        kind = lambda x: (x.version, x.layer, x.rate)
        ok = h is not None and at + h.length <= end and (first is None or kind(h) == kind(first))
        if ok and not synced:
            n = at + h.length
            after = header(n)
            ok = n == end or (after is not None and kind(after) == kind(h))
        if not ok:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if first is None:
            first = h
            s.version, s.layer, s.rate, s.channels = h.version, h.layer, h.rate, 1 if h.mode == 3 else 2
            if h.layer == 3 and _vbr_table(data, at, h, s):
                at += h.length
                continue
        s.offsets.append(at)
        headers.append(h)
        at += h.length
    s.frames, s.lengths = len(headers), [h.length for h in headers]
    if headers:
        s.samples = sum(h.samples for h in headers)
        s.min_kbps, s.max_kbps = min(h.kbps for h in headers), max(h.kbps for h in headers)
        _check(data, s, headers)
    return s


def _check(data: bytes, s: Stream, headers: list[Header]) -> None:
    """Checksums of layer III frames, in one go for all frames with equally long side information."""
    raw = np.frombuffer(data, np.uint8)
    for side in {h.side for h in headers if h.crc and h.layer == 3}:
        at = np.array([o for o, h in zip(s.offsets, headers, strict=True) if h.crc and h.side == side and h.length >= 6 + side])
        covered = raw[at[:, None] + np.r_[2, 3, 6 : 6 + side]]
        stored = raw[at + 4].astype(np.uint32) << 8 | raw[at + 5]
        s.checked += len(at)
        s.crc_errors += int((crc16(covered) != stored).sum())


# Storing: MPEG-1 layer III, 48 kHz, mono, with checksums. 3 bytes of frame for each kbit/s; 23 are header, checksum and side information.
# Behind the payload of a frame are at least 128 zeros, so that no payload lies where a reader looks for closing tags (ID3v1, APE).
_OVERHEAD = 23
_BY_UNITS = {4: 320, 3: 256, 2: 192, 1: 128}


def _frame_start(kbps: int) -> bytes:
    head = bytes([0xFF, 0xFA, KBPS[1, 3].index(kbps) << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None])[0])
    return head + crc.to_bytes(2, "big") + side


_STARTS = {k: _frame_start(k) for k in (*_BY_UNITS.values(), 64)}


def store(payload: bytes, unpadded: int) -> bytes:
    """A stream that carries payload, a positive multiple of UNIT bytes: ID3v2 tag, Info or Xing table, and frames of four units and one of the rest."""
    units, odd = divmod(len(payload), UNIT)
    if odd or not units:
        raise ValueError("the payload is no positive multiple of the unit")
    plan = [4] * (units // 4) + [units % 4] * bool(units % 4)
    body, at = [], 0
    for k in plan:
        size = 3 * _BY_UNITS[k]
        body += [_STARTS[_BY_UNITS[k]], payload[at : at + k * UNIT], bytes(size - _OVERHEAD - k * UNIT)]
        at += k * UNIT
    ends = np.cumsum([0] + [3 * _BY_UNITS[k] for k in plan])
    total = int(ends[-1]) + 192
    toc = [min(255, int(ends[i * len(plan) // 100] + 192) * 256 // total) for i in range(100)]
    table = _STARTS[64] + (b"Xing" if len(set(plan)) > 1 else b"Info") + struct.pack(">III", 7, len(plan), total) + bytes(toc)
    text = b"\x03payload_bytes\0%d" % unpadded
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(tag)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag + table + bytes(192 - len(table)) + b"".join(body)


def payload_of(data: bytes, s: Stream) -> bytes:
    """The payload of a stored stream, by the frames that parsing found."""
    out = []
    for at, n in zip(s.offsets, s.lengths, strict=True):
        out.append(data[at + _OVERHEAD : at + _OVERHEAD + (n - _OVERHEAD) // UNIT * UNIT])
    return b"".join(out)


def stored(rows: DataFrame, column: str = "content") -> DataFrame:
    """Adds media (binary): the column's bytes, padded with blanks to a positive multiple of UNIT, as an MPEG stream. Null counts as empty."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(at):
                raw = x.as_py() or b""
                made.append(store(raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), pa.array(made, pa.large_binary()).cast(pa.binary())], [n for n in batch.schema.names if n != column] + ["media"])

    kept = [f for f in rows.schema.fields if f.name != column]
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["media binary"]))


INDEX = "frames long, samples long, rate int, channels int, duration_us long, min_kbps int, max_kbps int, checked long, crc_errors long, skipped long, vbr_table string, table_agrees boolean, seek_offsets array<long>"


def indexed(rows: DataFrame, column: str = "media") -> DataFrame:
    """Media columns of MPEG audio: durations from counted frames, checksum results, tables, and the offset of every frame. Null media gives nulls and no frames."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(at):
                s = parse(x.as_py() or b"")
                agrees = None if s.table_frames is None else s.table_frames == s.frames
                out.append((s.frames, s.samples, s.rate, s.channels, s.samples * 1_000_000 // s.rate if s.rate else 0, s.min_kbps, s.max_kbps, s.checked, s.crc_errors, s.skipped, s.table or None, agrees, s.offsets))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.int64())]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            names = [f.split()[0] for f in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [n for n in batch.schema.names if n != column] + names)

    kept = [f for f in rows.schema.fields if f.name != column]
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [INDEX]))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, crc_errors long, skipped long, seek_offsets array<long>"


def read_back(media: DataFrame) -> DataFrame:
    """Per row of doc_id and media: the payload's and the stored form's digests, and what the frames say, all from the stored bytes.

    duration_us is exact to the microsecond below; seek_offsets has the place of every frame. crc_errors and skipped (bytes that belong to no frame) are 0
    for a sound stream. Null media gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                data = x.as_py()
                if data is None:
                    rows.append((None,) * 11)
                    continue
                s = parse(data)
                payload = payload_of(data, s)
                seek = zlib.crc32(np.array(s.offsets, "<u4").tobytes())
                feature = f"mpeg{s.version / 10:g} layer{s.layer} {s.rate}Hz frames={s.frames} samples={s.samples} kbps={s.min_kbps}-{s.max_kbps} crc={s.checked - s.crc_errors}/{s.checked} table={s.table}:{s.table_frames} seek={seek:08x}"
                unpadded = int(s.tags.get("payload_bytes", len(payload)))
                duration = s.samples * 1_000_000 // s.rate if s.rate else 0
                rows.append((unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, duration, s.crc_errors, s.skipped, s.offsets))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.split()[0] for f in DIGEST.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, DIGEST)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("content"))
    return read_back(written(stored(docs), "media"))


QUERIES = {"op2_mpeg_audio": op2_mpeg_audio}
