"""Quotation linking: quoted passages are parsed by level, hashed and joined to the messages they come from; conversations are put in reply order without quotes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import table, text_or_empty, written

_mark = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: A line that only announces a quotation, right before one.
_announced = re.compile(r"(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió|[-\s]*original message[-\s]*)\s*:?\s*$", re.I)


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of each line; level 0 is the message's own."""
    out = []
    for line in text.split("\n"):
        m = _mark.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(line: str) -> str:
    """Lower case, single blanks, no marks at the ends that mailers add or lose."""
    return " ".join(line.lower().split())


def digest(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """The text without quotes and their announcements, hashes of its own lines, and (level, hash) of quoted lines."""
    lines = levels(text)
    own, quoted = [], []
    for k, (level, line) in enumerate(lines):
        if level:
            if n := normal(line):
                quoted.append((level, digest(n)))
        elif not (_announced.match(line.strip()) and k + 1 < len(lines) and next((lv for lv, s in lines[k + 1 :] if lv or s.strip()), 0)):
            own.append(line)
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted else text
    return kept, list({digest(n) for line in own if (n := normal(line))}), list(dict.fromkeys(quoted))


#: Words of a shingle.
SHINGLE = 4
_sentence = re.compile(r"(?<=[.!?])\s+")


def wordings(lines: list[str]) -> list[list[tuple[int, bool]]]:
    """For each line of a passage the (hash, whole sentence or not) of the sentences and word shingles of the passage that have a word in it.

    Line breaks count as blanks and closing marks of sentences not at all, so neither depends on how the passage is wrapped.
    """
    words, line_of, first = [], [], set()
    for sentence in _sentence.split("\n".join(lines)):
        first.add(len(words))
        words += sentence.lower().split()
    for k, line in enumerate(lines):
        line_of += [k] * len(line.split())
    ends = sorted(first - {len(words)}) + [len(words)]
    out: list[list[tuple[int, bool]]] = [[] for _ in lines]
    spans = [(a, b, True) for a, b in zip(ends, ends[1:], strict=False)] + [(a, a + SHINGLE, False) for a in range(len(words) - SHINGLE + 1)]
    for a, b, whole in spans:
        wording = " ".join(w.rstrip(".!?") for w in words[a:b]).strip()
        if wording:
            h = digest(("s" if whole else "w") + wording)
            for k in range(line_of[a], line_of[b - 1] + 1):
                out[k].append((h, whole))
    return out


def quoted_wordings(text: str) -> list[tuple[int, int, int, bool]]:
    """(hash of the line, level, hash of a wording, whole sentence or not) of quoted lines. Lines of a level without one of another level or an empty one between them are a passage."""
    out, passage, before = [], [], 0
    for level, line in [*levels(text), (0, "")]:
        if passage and (level != before or not line.strip()):
            for own, found in zip(passage, wordings(passage), strict=True):
                out += [(digest(normal(own)), before, h, whole) for h, whole in found]
            passage = []
        if level and line.strip():
            passage.append(line)
        before = level
    return list(dict.fromkeys(out))


def rewrapped(rows: DataFrame, whole: DataFrame, left: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, source) of quoted lines (left, which no message has as a line) by the wordings of their passages.

    A wording belongs to the earliest message that has it. A line is linked if a whole sentence in it, or half of its shingles or more,
    belong to earlier messages: to the one with most of them, or the earliest of such.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(c, t, *q) for c, t, text in zip(*(x.to_pylist() for x in batch.columns), strict=True) for q in quoted_wordings(text)]
            columns = list(zip(*got, strict=True)) or [[]] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "hash", "level", "wording", "sentence"])

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(c, t, h) for c, t, text in zip(*(x.to_pylist() for x in batch.columns), strict=True) for h in {h for line in wordings(text.split("\n")) for h, _ in line}]
            kinds = [batch.column(0).type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*got, strict=True)) or [[]] * 3, kinds, strict=True)], ["conv_id", "turn", "wording"])

    raw = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), text_or_empty().alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    asks = raw.join(left.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi").mapInArrow(asked, f"conv_id {kind}, turn long, hash long, level int, wording long, sentence boolean")
    asks = asks.join(left, ["conv_id", "turn", "hash"], "left_semi").select("conv_id", "turn", "hash", "wording", "sentence").distinct()
    owns = whole.join(left.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "text").mapInArrow(owned, f"conv_id {kind}, turn long, wording long")
    first = owns.groupBy("conv_id", "wording").agg(F.min("turn").alias("source"))
    met = asks.join(first, ["conv_id", "wording"], "left").withColumn("source", F.expr("CASE WHEN source < turn THEN source END"))
    each = met.groupBy("conv_id", "turn", "hash", "source").agg(F.count("*").alias("n"), F.count_if("sentence").alias("sentences"))
    there = F.col("source").isNotNull()
    lines = each.groupBy("conv_id", "turn", "hash").agg(
        F.max(F.when(there, F.struct("n", -F.col("source"), "source"))).alias("best"),
        F.sum(F.when(there, F.col("sentences")).otherwise(0)).alias("sentences"),
        F.sum(F.when(there, F.col("n") - F.col("sentences")).otherwise(0)).alias("found"),
        F.sum(F.col("n") - F.col("sentences")).alias("shingles"),
    )
    return lines.where("best is not null and (sentences > 0 or 2 * found >= shingles)").select("conv_id", "turn", "hash", F.col("best.source").alias("source"))


PARSED = "turn long, role string, text string, own array<long>, quotes array<struct<level:int,hash:bigint>>"


def parsed(rows: DataFrame) -> DataFrame:
    """conv_id as it is, turn as an integer (null where it is none), role, the text without quotes, hashes of its own lines and of quoted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(t.as_py()) for t in batch.column(3)]
            quotes = pa.array([[{"level": a, "hash": b} for a, b in q] for _, _, q in got], pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int64())), quotes], ["conv_id", "turn", "role", "text", "own", "quotes"])

    plain = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_or_empty().alias("text"))
    return plain.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PARSED}")


def in_ranges(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows, written in ranges of (conv_id, *order) with the number of their range, and the few (conv_id, _range) of conversations that lie in several ranges.

    A conversation of any length is so dealt over tasks, and what follows in order can be computed in each range; there are at most two such
    conversations for each range, so the second table is small whatever the input.
    """
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    held = written(dealt.withColumn("_range", F.spark_partition_id()), name)
    return held, held.groupBy("conv_id").agg(F.min("_range").alias("_low"), F.max("_range").alias("_high")).where("_low < _high").select("conv_id")


def with_previous(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn) with previous, the turn before in the conversation."""
    held, long = in_ranges(turns, ["turn"], "turns")
    here = held.withColumn("_before", F.lag("turn").over(Window.partitionBy("_range", "conv_id").orderBy("turn")))
    last = held.join(F.broadcast(long), "conv_id", "left_semi").groupBy("conv_id", "_range").agg(F.max("turn").alias("_last"))
    # The last turn of the nearest earlier range that has one, for the first turn of a range.
    pairs = last.join(last.select("conv_id", F.col("_range").alias("_r"), F.col("_last").alias("_l")), "conv_id").where("_r < _range").groupBy("conv_id", "_range").agg(F.max("_l").alias("_earlier"))
    return here.join(F.broadcast(pairs), ["conv_id", "_range"], "left").select("conv_id", "turn", F.coalesce("_before", "_earlier").alias("previous"))


def with_position(rows: DataFrame, order: list[str], ties: list[str]) -> DataFrame:
    """rows with position, from 1, in their conversation by order, then ties."""
    held, long = in_ranges(rows, order, "placed")
    here = held.withColumn("_at", F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy(*order, *ties)))
    count = held.join(F.broadcast(long), "conv_id", "left_semi").groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    before = count.join(count.select("conv_id", F.col("_range").alias("_r"), F.col("_n").alias("_m")), "conv_id").where("_r < _range").groupBy("conv_id", "_range").agg(F.sum("_m").alias("_off"))
    got = here.join(F.broadcast(before), ["conv_id", "_range"], "left").withColumn("position", (F.col("_at") + F.coalesce("_off", F.lit(0))).cast("long"))
    return got.drop("_range", "_at", "_off")


def threaded(rows: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) in reply order: reply_to, n_quotes, n_linked, depth, root and position, with text free of quotes.

    A quoted line belongs to the earliest message of its conversation that has it as its own line, before the quoting one; a line that
    none has, as it was rewrapped or trimmed, to the one that has the sentences or words of its passage (see rewrapped). A message
    answers the message that most of its quoted lines belong to (ties: the outermost level, then the latest); without such lines
    it answers the turn before it, and the first turn answers nothing. position orders a conversation by root, depth and turn, so
    that every message comes after the one it answers. Rows that share a turn are variants of one message: they answer and are
    answered together, and are ordered by role and text. Rows without conv_id or turn (one that is no integer counts as none) stay as
    they are, linked with nothing. conv_id may be of any type that can be ordered.
    """
    p = written(parsed(rows), "messages")
    whole = p.where("conv_id is not null and turn is not null")
    turns = whole.select("conv_id", "turn").distinct()
    # The first message with a line, and each quoting of it, meet on conversation and hash: one row for each quoted line.
    first = whole.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    asked = whole.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash").groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"))
    met = asked.join(first, ["conv_id", "hash"], "left").withColumn("source", F.expr("CASE WHEN source < turn THEN source END"))
    left = written(met.where("source is null").select("conv_id", "turn", "hash"), "unlinked")
    if not left.isEmpty():
        more = rewrapped(rows, whole, left).withColumnRenamed("source", "more")
        met = written(met.join(more, ["conv_id", "turn", "hash"], "left").withColumn("source", F.coalesce("source", "more")).drop("more"), "linked")
    counted = met.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"))
    votes = met.where("source is not null").groupBy("conv_id", "turn", "source").agg(F.count("*").alias("n"), F.min("level").alias("level"))
    chosen = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", -F.col("level"), "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("quoted"))
    up = with_previous(turns).join(chosen, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted", "previous").alias("reply_to"))
    up = written(up, "replies")
    # Pointer doubling: after k rounds a message knows the one 2 ** k answers up, or its root and how far that is. Only those that don't know it yet go on.
    state = written(up.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("to"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("depth"), F.col("reply_to").isNull().alias("done")), "depths")
    while not state.where("not done").isEmpty():
        far = state.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = state.where("not done").join(far, ["conv_id", "to"]).select("conv_id", "turn", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        state = written(state.where("done").unionByName(moved), "depths")
    state = state.drop("done")
    at = up.join(state.withColumnRenamed("to", "root"), ["conv_id", "turn"]).join(counted, ["conv_id", "turn"], "left")
    out = with_position(whole.drop("own", "quotes").join(at, ["conv_id", "turn"]), ["root", "depth", "turn", "role"], ["text"])
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("conv_id", "turn", "role", "text", "reply_to", n("n_quotes"), n("n_linked"), F.col("depth").cast("long").alias("depth"), "root", "position")
    odd = p.where("conv_id is null or turn is null").select("conv_id", "turn", "role", "text", *(F.lit(None).cast("long").alias(c) for c in ("reply_to",)), *(F.lit(0).cast("long").alias(c) for c in ("n_quotes", "n_linked")), *(F.lit(None).cast("long").alias(c) for c in ("depth", "root", "position")))
    return out.unionByName(odd)


def op4_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threaded(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_quotation_threads": op4_quotation_threads}
