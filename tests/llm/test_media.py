"""MPEG streams: parsing of made streams and exact round trips."""

import hashlib
import zlib

import pytest

from folioscope.llm import media
from tests.llm.test_tokens import ROWS, frame


def header(word):
    return media.parse_header(word)


def test_headers():
    h = header(0xFFFB9064)  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz, joint stereo
    assert (h.version, h.layer, h.crc, h.kbps, h.rate, h.length, h.samples, h.side) == (10, 3, False, 128, 44100, 417, 1152, 32)
    assert header(0xFFFB9264).length == 418
    assert (header(0xFFF388C4).samples, header(0xFFF388C4).kbps) == (576, 64)
    assert header(0xFFFF9064).length == 4 * (12 * 288000 // 44100)
    for bad in (0, 0xFFFBF064, 0xFFFB0064, 0xFFFB9C64, 0xFFEB9064, 0xFFF99064, 0xFFFB9066):
        assert header(bad) is None


def test_known_checksum():
    import numpy as np

    # CRC-16 with polynomial 8005 from all ones, unreflected (CRC-16/CMS).
    assert media.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xAEE7


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 768, 769, 5000])
def test_round_trip_with_junk_tags_and_damage(n):
    raw = bytes((i * 7 + i // 251) % 255 for i in range(n))
    payload = raw + b" " * (-n % 192 if n else 192)
    data = media.store(payload, n)
    s = media.parse(data)
    assert media.payload_of(data, s) == payload
    assert (s.crc_errors, s.skipped, s.checked, s.table_frames) == (0, 0, s.frames, s.frames)
    assert s.table_bytes == len(data) - 10 - media._synchsafe(data[6:10])
    assert s.samples == 1152 * s.frames and s.seek(s.samples - 1) == s.offsets[-1]
    assert s.tags == {"payload_bytes": str(n)}
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    junk = media.parse(data + v1)
    assert junk.offsets == s.offsets and junk.tags["v1.title"] == "Title"
    tag = 10 + media._synchsafe(data[6:10])
    early = media.parse(b"\xff\xfbnoise\xff" + data[tag:])
    assert early.frames == s.frames and early.skipped == 8
    hurt = bytearray(data)
    hurt[s.offsets[-1] + 8] ^= 1
    assert media.parse(bytes(hurt)).crc_errors == 1
    if s.frames > 2:
        lost = bytearray(data)
        lost[s.offsets[1] : s.offsets[1] + 4] = b"\0\0\0\0"
        got = media.parse(bytes(lost))
        assert got.frames == s.frames - 1 and got.skipped == s.lengths[1]


@pytest.mark.parametrize("units", range(1, 9))
def test_letters_of_closing_tags_anywhere_in_a_text(units):
    for mark in (b"TAG", b"APETAGEX"):
        for at in range(units * 192 - len(mark) + 1):
            payload = (b"x" * at + mark).ljust(units * 192)
            data = media.store(payload, at + len(mark))
            s = media.parse(data)
            assert media.payload_of(data, s) == payload, (mark, at)
            assert s.tags == {"payload_bytes": str(at + len(mark))} and s.skipped == 0


def test_no_audio():
    for data in (b"", b"\xff" * 50, b"ID3\x03\x00\x00\x00\x00\x00\x01", b"hello" * 100):
        s = media.parse(data)
        assert (s.frames, s.samples) == (0, 0)
    with pytest.raises(IndexError):
        s.seek(0)
    with pytest.raises(ValueError):
        media.store(b"", 0)


def test_lossless_rows(spark):
    docs = frame(spark, ROWS).selectExpr("doc_id", "encode(coalesce(text, ''), 'UTF-8') content")
    got = {tuple(r)[:7] for r in media.read_back(media.stored(docs)).collect()}
    want = set()
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        m = media.store(p, len(raw))
        want.add((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()))
    assert got == want


def test_index_columns_and_nulls(spark):
    m = media.store(b"x" * 1920, 1920)
    rows = spark.createDataFrame([(1, "a", bytearray(m)), (2, None, None), (3, "c", bytearray(b"no audio"))], "id int, frames_of string, media binary")
    a, b, c = media.indexed(rows).orderBy("id").collect()
    assert (a.frames, a.duration_us, a.vbr_table, a.table_agrees, a.crc_errors, len(a.seek_offsets)) == (3, 72000, "Xing", True, 0, 3)
    assert (b.frames, b.vbr_table, b.table_agrees, b.seek_offsets) == (0, None, None, [])
    assert c.frames == 0 and c.skipped == 8
    assert media.indexed(rows.limit(0)).count() == 0
