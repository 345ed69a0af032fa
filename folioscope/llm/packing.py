"""Packing: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import kept, table, text_or_empty, written
from folioscope.llm.pieces import FoldedWordEncoder, encoded_batch

CAPACITY = 4096
END_ID = 2
#: Documents that a group holds on average. More leave less padding; a group is one task's work.
GROUP_DOCS = 4096
VOCABULARY = "word_bpe_49k.json"
#: Characters that a worker encodes at a time, and bytes of chunks that it remembers: half of what pieces.py would take, as a stage of the pipeline shares its executors' memory with others.
PORTION, REMEMBERED = 1 << 22, 20 << 20
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Leftmost bin that still holds an amount, in logarithmic time: each inner node has the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, amount: int) -> tuple[int, int]:
        """The bin for amount and what it had left before; its room is lowered."""
        room, at = self.room, 1
        if room[1] < amount:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if room[at] < amount:
                at += 1
        had = room[at]
        room[at] = had - amount
        k = at >> 1
        while k:
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
            k >>= 1
        return at - self.leaves, had


def first_fit_decreasing(lengths, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in their order; ties keep it. A length over capacity raises ValueError."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    bins = Tournament(len(lengths), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in order:
        b, had = bins.place(int(lengths[i]))
        out[i] = (b, capacity - had)
    return out


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per document: doc_id, doc_tokens, crcs (unsigned CRC-32 of each capacity-sized piece of its ids) and salt.

    The ids are those of the tokenizers library and end_id; a null text is empty and so has end_id alone. The salt is drawn from
    the row's place, not its content, so that equal rows don't share a group; it is fixed once this table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("folded", path), lambda: FoldedWordEncoder(path, REMEMBERED))
        end = np.array([end_id], "<u4")
        for batch in batches:
            tokens, crcs = [], []
            for x in encoded_batch(encoder, batch.column(1), PORTION):
                got = np.concatenate([x, end], dtype="<u4")
                tokens.append(len(got))
                crcs.append([zlib.crc32(got[k : k + capacity]) for k in range(0, len(got), capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>").withColumn("salt", F.xxhash64(F.monotonically_increasing_id(), F.lit(20_25)))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Sequences of at most capacity ids from what token_pieces gives: a row per piece.

    Documents go to groups at random; each group is packed on its own by first-fit decreasing. A longer document is cut at
    multiples of capacity. sequence_id is the group's number in the high 32 bits and the bin's in the low.
    No rows give no rows; rows with equal doc_id are documents of their own.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_docs))
    # Exactly rows / groups documents each on average, and a task for a group; the salt is uniform.
    grouped = pieces.withColumn("g", F.pmod("salt", F.lit(groups)))

    def run(key, t):
        g = key[0].as_py()
        order = np.lexsort((t.column("doc_tokens").to_numpy(), t.column("doc_id").to_numpy(zero_copy_only=False), t.column("salt").to_numpy()))
        t = t.take(pa.array(order))
        tokens, crcs = t.column("doc_tokens").to_numpy(), t.column("crcs").combine_chunks()
        per = np.diff(crcs.offsets.to_numpy())
        doc = np.repeat(np.arange(len(tokens)), per)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
        length = np.minimum(capacity, tokens[doc] - start)
        put = np.array(first_fit_decreasing(length, capacity), np.int64).reshape(-1, 2)
        ids = t.column("doc_id").take(pa.array(doc))
        return pa.table({"doc_id": ids, "start": start.astype(np.int64), "length": length.astype(np.int64), "ids_crc32": crcs.flatten(), "doc_tokens": tokens[doc], "sequence_id": (g << 32) + put[:, 0], "offset": put[:, 1]})

    return grouped.select("g", "doc_id", "doc_tokens", "crcs", "salt").groupBy("g").applyInArrow(run, PIECE_SCHEMA)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return pack(written(token_pieces(docs, path), "pieces"))


def op7_pack_first_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pack_first_fit_decreasing": op7_pack_first_fit_decreasing}
