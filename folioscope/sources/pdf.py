"""What can be known of PDF bytes without an engine: what they are, and which signatures they carry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_WINDOW = 1024


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows of path, modificationTime, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def is_pdf(content):
    """The session's rule: the header is at the first byte."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def is_pdf_to_merge(content):
    """The merger's rule: the header is within the first kilobyte."""
    return F.coalesce(F.instr(F.decode(F.substring(content, 1, MERGE_WINDOW), "ISO-8859-1"), "%PDF-") > 0, F.lit(False))


_byte_range = re.compile(rb"/ByteRange\s*\[\s*([^\]]*)\]")
_contents = re.compile(rb"/Contents\s*<([0-9A-Fa-f\s]*)>")
_text = re.compile(rb"/(Name|Reason|Location|M|SubFilter)\s*(?:\(((?:\\.|[^\\)])*)\)|/(\S+)|<([0-9A-Fa-f\s]*)>)")


def _string(raw: bytes) -> str:
    raw = re.sub(rb"\\(.)", rb"\1", raw, flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _dictionary(data: bytes, at: int) -> bytes:
    """The << >> around a place, with those inside it."""
    depth, start = 0, at
    while start > 0:
        start -= 1
        if data[start : start + 2] == b">>":
            depth += 1
        elif data[start : start + 2] == b"<<":
            if not depth:
                break
            depth -= 1
    depth, end = 0, start
    while end < len(data):
        if data[end : end + 2] == b"<<":
            depth, end = depth + 1, end + 2
        elif data[end : end + 2] == b">>":
            depth, end = depth - 1, end + 2
            if not depth:
                break
        else:
            end += 1
    return data[start:end]


def signatures(data: bytes) -> list[dict]:
    """Signature fields in file order: byte_range, contents, name, reason, signed (as written), and whether the range covers the file."""
    out = []
    for m in _byte_range.finditer(data):
        try:
            span = [int(x) for x in m[1].split()]
        except ValueError:
            span = []
        body = _dictionary(data, m.start())
        values = {k.decode(): _string(bytes.fromhex(h.decode()) if h else name or s) for k, s, name, h in _text.findall(body)}
        c = _contents.search(body)
        raw = bytes.fromhex(re.sub(rb"\s", b"", c[1]).decode()) if c and len(re.sub(rb"\s", b"", c[1])) % 2 == 0 else b""
        good = len(span) == 4 and min(span) >= 0 and span[0] + span[1] <= span[2] and span[2] + span[3] <= len(data)
        out.append({"byte_range": span, "contents": raw, "name": values.get("Name"), "reason": values.get("Reason"), "signed": values.get("M"), "good_range": good, "covers_file": good and span[0] == 0 and span[2] + span[3] == len(data)})
    return out


def covered(data: bytes, byte_range: list[int]) -> bytes:
    a, n, b, m = byte_range
    return data[a : a + n] + data[b : b + m]


SEAL = "path string, signed boolean, unbroken boolean, n_signatures int, signatures array<struct<byte_range:array<bigint>,name:string,reason:string,signed:string,intact:boolean,covers_file:boolean>>"


def checked_seals(documents: DataFrame, verify: Callable[[bytes, bytes], bool] | None = None) -> DataFrame:
    """Seals of (path, content): unbroken if all signatures are intact and the last covers the file.

    verify(covered bytes, signature) decides whether one is intact; without it a good byte range counts, as no cryptography is here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("byte_range", pa.list_(pa.int64())), ("name", pa.string()), ("reason", pa.string()), ("signed", pa.string()), ("intact", pa.bool_()), ("covers_file", pa.bool_())])
        for batch in batches:
            rows = []
            for x in batch.column(1):
                data = x.as_py() or b""
                found = signatures(data)
                for s in found:
                    s["intact"] = s["good_range"] and (verify is None or verify(covered(data, s["byte_range"]), s["contents"]))
                rows.append((bool(found), bool(found) and all(s["intact"] for s in found) and found[-1]["covers_file"], len(found), [{k: s[k] for k in ("byte_range", "name", "reason", "signed", "intact", "covers_file")} for s in found]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(kind))], ["path", "signed", "unbroken", "n_signatures", "signatures"])

    return documents.select("path", "content").mapInArrow(run, SEAL)
