"""Token ids on disk as wavelet matrices: one self-contained blob per shard, with rank and select on succinct bit-planes.

Format of a blob, little-endian: magic FSWM, version u8 (2), planes u8, u16 zero, tokens u64, documents u64, then the documents' ids
(i64 each), which of them are null (bits, lowest first, in whole bytes) and token counts (u32 each), the number of zeros of each plane (u64 each), and for each plane, the highest bit first,
its bits (packed, lowest bit first, in whole 64-bit words) and its ranks (u32: ones before each block of 512 bits, and all).
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import kept, table, text_or_empty, written
from folioscope.llm.pieces import ByteLevelEncoder, encoded_batch

MAGIC = b"FSWM"
BLOCK = 512
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: A shard is closed once it holds so many tokens.
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sBBHQQ")


def build(tokens: np.ndarray, doc_ids, counts, planes: int = 16) -> bytes:
    """The blob of a shard. Tokens must be below 2 ** planes; counts says how many of them each document has; an id may be None."""
    null = np.fromiter((d is None for d in doc_ids), bool, len(doc_ids))
    doc_ids = [d or 0 for d in doc_ids]
    tokens = np.ascontiguousarray(tokens, np.uint32)
    n = len(tokens)
    if n and int(tokens.max()) >> planes:
        raise ValueError("a token has more bits than the matrix has planes")
    if int(np.sum(counts, dtype=np.int64)) != n:
        raise ValueError("the counts don't add up to the tokens")
    zeros, body = [], []
    at = tokens.astype(np.uint16) if planes <= 16 else tokens
    for level in range(planes - 1, -1, -1):
        bit = ((at >> at.dtype.type(level)) & at.dtype.type(1)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        words = -(-n // BLOCK) * (BLOCK // 8)
        packed = np.concatenate([packed, np.zeros(words - len(packed), np.uint8)])
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        body += [packed.tobytes(), np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]).tobytes()]
        low = at.compress(~bit)
        zeros.append(len(low))
        at = np.concatenate([low, at.compress(bit)])
    head = _HEAD.pack(MAGIC, 2, planes, 0, n, len(doc_ids))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.packbits(null, bitorder="little").tobytes(), np.asarray(counts, "<u4").tobytes(), np.asarray(zeros, "<u8").tobytes(), *body])


class WaveletMatrix:
    """Reads a blob: access, rank and select of single tokens without unpacking, and all tokens at once."""

    def __init__(self, blob: bytes):
        magic, version, self.planes, _, self.n, docs = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != 2:
            raise ValueError("not a wavelet matrix of this version")
        at = _HEAD.size
        take = lambda kind, k: (np.frombuffer(blob, kind, k, at), at + np.dtype(kind).itemsize * k)
        self.doc_ids, at = take("<i8", docs)
        null, at = take("<u1", -(-docs // 8))
        self.null = np.unpackbits(null, count=docs, bitorder="little").astype(bool)
        self.counts, at = take("<u4", docs)
        zeros, at = take("<u8", self.planes)
        self.zeros = [int(z) for z in zeros]
        blocks = -(-self.n // BLOCK)
        self.bits, self.ranks, self._inner = [], [], {}
        for _ in range(self.planes):
            b, at = take("<u1", blocks * (BLOCK // 8))
            r, at = take("<u4", blocks + 1)
            self.bits.append(b)
            self.ranks.append(r)
        if at != len(blob):
            raise ValueError("the blob's length is wrong")

    def _ones(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane: the rank before its block, whole words of the block, and the rest of a word."""
        if not self.n:
            return np.zeros(len(i), np.int64)
        words = self.bits[plane].view(np.uint64).reshape(-1, BLOCK // 64)
        if plane not in self._inner:
            inner = np.bitwise_count(words).astype(np.int64)
            self._inner[plane] = np.cumsum(inner, 1) - inner
        block, rest = i // BLOCK, i % BLOCK
        inside = block < len(words)
        b, w = np.where(inside, block, 0), rest // 64
        part = np.bitwise_count(words[b, w] & ((np.uint64(1) << (rest % 64).astype(np.uint64)) - np.uint64(1)))
        return self.ranks[plane][block].astype(np.int64) + np.where(inside, self._inner[plane][b, w] + part, 0)

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The tokens at positions."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("a position outside the shard")
        token = np.zeros(len(at), np.int64)
        for p in range(self.planes):
            bit, ones = self.bits[p][at >> 3] >> (at & 7).astype(np.uint8) & 1, self._ones(p, at)
            token = token << 1 | bit
            at = np.where(bit, self.zeros[p] + ones, at - ones)
        return token

    def access(self, i: int) -> int:
        """Token i."""
        return int(self.access_many(np.array([i]))[0])

    def _range(self, token: int, at: np.ndarray) -> tuple[int, np.ndarray]:
        """Where, after the last plane, the token's run starts and where its occurrences before each position end."""
        at = np.append(0, at)
        for p in range(self.planes):
            ones = self._ones(p, at)
            at = self.zeros[p] + ones if token >> (self.planes - 1 - p) & 1 else at - ones
        return int(at[0]), at[1:]

    def rank_many(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of token before each position."""
        at = np.minimum(np.asarray(at, np.int64), self.n)
        if token >> self.planes:
            return np.zeros(len(at), np.int64)
        a, b = self._range(token, at)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        return int(self.rank_many(token, np.array([i]))[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bits(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) such bits of a plane."""
        r = self.ranks[plane].astype(np.int64)
        before = r if bit else np.arange(len(r)) * BLOCK - r
        block = np.searchsorted(before, k, "right") - 1
        left = k - before[block]
        # The word of the block by the bits before each word, then the place in the word.
        words = self.bits[plane].view(np.uint64).reshape(-1, BLOCK // 64)[block]
        words = words if bit else ~words
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        word, row = (upto <= left[:, None]).sum(1), np.arange(len(k))
        left -= np.where(word > 0, upto[row, word - 1], 0)
        inside = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + (np.cumsum(inside, 1, dtype=np.int16) > left[:, None]).argmax(1)

    def select_many(self, token: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) occurrences of token."""
        k = np.asarray(k, np.int64)
        a, b = self._range(token, np.array([self.n])) if not token >> self.planes else (0, [0])
        if len(k) and not (0 <= k.min() and k.max() < b[0] - a):
            raise IndexError("fewer occurrences")
        out = []
        # A block of bits is unpacked for each occurrence, so some thousands at a time.
        for s in range(0, len(k), 4096):
            i = a + k[s : s + 4096]
            for p in range(self.planes - 1, -1, -1):
                bit = token >> (self.planes - 1 - p) & 1
                i = self._select_bits(p, bit, i - self.zeros[p] if bit else i)
            out.append(i)
        return np.concatenate(out) if out else k

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token."""
        return int(self.select_many(token, np.array([k]))[0])

    def occurrences(self, token: int) -> list[int]:
        """All positions of token, ascending."""
        return self.select_many(token, np.arange(self.count(token))).tolist()

    def tokens(self) -> np.ndarray:
        """All tokens: undoes the stable partition of each plane, from the last to the first."""
        low = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self.bits[p], count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(low)
            out[np.flatnonzero(~bit)] = low[: self.zeros[p]]
            out[np.flatnonzero(bit)] = low[self.zeros[p] :] | low.dtype.type(1 << (self.planes - 1 - p))
            low = out
        return low


SHARDS = "part long, seq long, first_doc long, part_start long, tokens long, docs long, blob binary"


#: Documents that are looked at for each range, to cut ranges of doc_id.
SAMPLED = 200


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, lead (the text's first 16 bytes), row (its place in the table) and text."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.encode(text, "UTF-8"), 1, 16).alias("lead"), F.monotonically_increasing_id().alias("row"), text.alias("text"))


def _key(doc_id: int | None, lead: bytes, row: int) -> tuple:
    return doc_id is not None, doc_id or 0, bytes(lead), row


def ranges(rows: DataFrame, parts: int) -> list[tuple]:
    """Keys that cut the rows into about equal ranges, at most parts of them, from a sample whose size depends on parts alone."""
    n = rows.count()
    some = rows.select("doc_id", "lead", "row") if n <= SAMPLED * parts else rows.select("doc_id", "lead", "row").sample(False, SAMPLED * parts / n, 7)
    keys = sorted(_key(*r) for r in some.collect())
    return [keys[k * len(keys) // parts] for k in range(1, parts)] if len(keys) >= parts else keys[1:]


def encoded(rows: DataFrame, path: str, bounds: list[tuple], end_id: int = END_ID) -> DataFrame:
    """Per document of keyed() its key, the number of its range and ids (unsigned 16-bit, with end_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = kept(("byte-level", path), lambda: ByteLevelEncoder(path)), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            got = pa.array([x.tobytes() + end for x in encoded_batch(encoder, batch.column(3))], pa.binary())
            part = [bisect_right(bounds, _key(*k)) for k in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns[:3], got], ["part", "doc_id", "lead", "row", "ids"])

    return rows.mapInArrow(run, "part int, doc_id long, lead binary, row long, ids binary")


def shards(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Rows of documents as shards in ascending doc_id order, written: ranges of doc_id by partition, a blob after every shard_tokens tokens.

    A null text is empty; a null doc_id sorts first. Rows with equal doc_id are documents of their own, ordered by their first bytes,
    then by their place in the table; however many they are, ranges may part them. Texts are encoded where they are, so that only ids are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = 0, 0, 0
        ids: list = []
        got: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, start, ids, got, size
            tokens = np.frombuffer(b"".join(got), "<u2")
            row = [part, seq, ids[0], start, len(tokens), len(ids), build(tokens, ids, [len(x) // 2 for x in got])]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "first_doc", "part_start", "tokens", "docs", "blob"])
            seq, start, ids, got, size = seq + 1, start + len(tokens), [], [], 0
            return out

        for batch in batches:
            for of, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if of != part:
                    if ids:
                        yield close()
                    part, seq, start = of, 0, 0
                ids.append(d)
                got.append(x.as_py())
                size += len(got[-1]) // 2
                if size >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    rows, parts = keyed(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = ranges(rows, parts)
    dealt = encoded(rows, path, bounds, end_id).repartitionById(len(bounds) + 1, "part")
    return written(dealt.sortWithinPartitions("part", "doc_id", "lead", "row").select("part", "doc_id", "ids").mapInArrow(run, SHARDS), "wavelet")


def documents_of(stored: DataFrame, end_id: int = END_ID) -> DataFrame:
    """A row per document of stored shards: doc_id, start (ids before it over all shards), n_tokens, the ids' unsigned CRC-32, and
    end_rank, how many end ids its shard has before its last one.

    A document's last id must be the end id, and selecting that occurrence must lead back to it; else the shard is damaged: ValueError.
    """
    # One small row for each range partition: what the partitions before it hold.
    per_part = {r["part"]: r["t"] for r in stored.groupBy("part").agg(F.sum("tokens").alias("t")).collect()}
    before, total = {}, 0
    for p in sorted(per_part):
        before[p] = total
        total += per_part[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                m = WaveletMatrix(blob.as_py())
                ends = np.cumsum(m.counts, dtype=np.int64)
                ranks = m.rank_many(end_id, ends - 1)
                if (m.access_many(ends - 1) != end_id).any() or (m.select_many(end_id, ranks) != ends - 1).any():
                    raise ValueError("a shard's documents don't end where its planes say")
                tokens = m.tokens().astype("<u4")
                starts = ends - m.counts
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(m.doc_ids, pa.int64(), mask=m.null), pa.array(starts + (at + before[part])), pa.array(m.counts.astype(np.int64)), pa.array(crcs, pa.int64()), pa.array(ranks)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "end_rank"])

    return stored.select("part", "part_start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, end_rank long")


def op8_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return documents_of(shards(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


QUERIES = {"op8_wavelet_matrix": op8_wavelet_matrix}
