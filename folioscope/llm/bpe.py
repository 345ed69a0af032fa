"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding through a UTF-8 state machine.

The encoding of a text's prefix that ends at a token is a prefix of that token chain, and a chain is an encoding exactly if each
neighbouring pair is: merging the two tokens' bytes gives the two tokens back. So after each byte exactly one token can end there.
A state holds, for each earlier place from which some token may still reach further, the trie node reached and the tokens since
what all those places share; what they share is settled and is emitted. The longest token bounds how long a token can stay open.
States and transitions are made when a text first needs them. Many pieces go through at once, a byte of each at a time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import kept, table, text_or_empty
from folioscope.llm.pieces import BlankChunks, encoded_batch, spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Transitions that a worker keeps before it starts over from the states in use, and compatible pairs of tokens.
KEPT_TRANSITIONS, KEPT_PAIRS = 300_000, 400_000
#: Pieces below which bytes are walked one piece after the other.
NARROW = 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbouring pair of lowest rank, leftmost first, until none is in ranks."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Ids of one piece of text, byte by byte; whole pieces in ranks are one id, as in rank-file tokenizers."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_TRANSITIONS):
        self.ranks, self.kept = ranks, kept
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = {0}
        for piece, i in ranks.items():
            node = 0
            for b in piece:
                self.inner.add(node)
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.spines: dict[int, list[tuple[bytes, int]]] = {}
        self.fits: dict[int, bool] = {}
        self._forget_emitted()
        self._start_over([])

    def _forget_emitted(self) -> None:
        # Emissions are stretches of pool; the first is empty.
        self.pool, self.first, self.many = array("I"), array("q", [0]), array("i", [0])

    def _start_over(self, states: list[tuple]) -> list[int]:
        """Only the start and the given states stay; returns their numbers."""
        self.ids_of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: The emission if a piece ends in a state.
        self.ends = array("i")
        #: By state and byte the transition; its next state and its emission.
        self.step: dict[int, int] = {}
        self.to, self.emits = array("i"), array("i")
        # A state is the last settled token, and for each place its trie node and its open tokens.
        # The last place is that where all bytes so far end, so its open tokens are what an ending piece still emits.
        return [self._state(s) for s in [(-1, ((0, ()),)), *states]][1:]

    def _emission(self, tokens: tuple[int, ...]) -> int:
        if not tokens:
            return 0
        self.first.append(len(self.pool))
        self.many.append(len(tokens))
        self.pool.extend(tokens)
        return len(self.many) - 1

    def _state(self, state: tuple) -> int:
        i = self.ids_of.get(state)
        if i is None:
            i = self.ids_of[state] = len(self.states)
            self.states.append(state)
            self.ends.append(-1)
        return i

    def _end(self, i: int) -> int:
        """The emission if a piece ends in state i."""
        if self.ends[i] < 0:
            self.ends[i] = self._emission(self.states[i][1][-1][1])
        return self.ends[i]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts of a token at its right or left end, from a byte to the whole, each with the rank at which it becomes the next; empty if merging its bytes doesn't give it."""
        key = token << 1 | right
        got = self.spines.get(key)
        if got is None:
            piece = self.bytes_of[token]
            parts, at_end = [piece[i : i + 1] for i in range(len(piece))], []
            last = -1 if right else 0
            end = parts[last]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                rank = self.ranks.get(parts[best] + parts[best + 1])
                if rank is None:
                    at_end = None
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
                if parts[last] != end:
                    at_end.append((end, rank))
                    end = parts[last]
            got = self.spines[key] = [] if at_end is None else [*at_end, (end, 1 << 60)]
        return got

    def _fit(self, before: int, token: int) -> bool:
        """Whether token may follow before (-1: the start): no merge across their border comes first.

        At the border meet a part of each. A merge of the two wins if its rank is below the rank at which the left part grows, and
        not above that at which the right one does, as of equal ranks the leftmost merges first.
        """
        key = (before + 1) << 32 | token
        got = self.fits.get(key)
        if got is None:
            b = self._spine(token, False)
            if before < 0:
                got = bool(b)
            else:
                a = self._spine(before, True)
                got, i, j, rank_of = bool(a and b), 0, 0, self.ranks.get
                while got:
                    (x, grows), (y, follows) = a[i], b[j]
                    m = rank_of(x + y)
                    if m is not None and m < grows and m <= follows:
                        got = False
                    elif i + 1 == len(a) and j + 1 == len(b):
                        break
                    elif grows <= follows:
                        i += 1
                    else:
                        j += 1
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            self.fits[key] = got
        return got

    def _transition(self, key: int) -> int:
        """The transition from a state by a byte (state << 8 | byte), made when it is first needed."""
        got = self.step.get(key)
        if got is None:
            to, emitted = self._advance(self.states[key >> 8], key & 255)
            to, emitted = self._state(to), self._emission(emitted)
            got = self.step[key] = len(self.to)
            self.to.append(to)
            self.emits.append(emitted)
        return got

    def _advance(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        last, places = state
        child, token, inner, fits = self.child, self.token, self.inner, self.fits
        alive, here, settles = [], None, True
        for node, path in places:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if here is None and (t := token[node]) >= 0:
                before = path[-1] if path else last
                fit = fits.get((before + 1) << 32 | t)
                if fit or (fit is None and self._fit(before, t)):
                    here = (*path, t)
            if node in inner:
                alive.append((node, path))
                if not path:
                    settles = False
        if here is None:
            raise ValueError(f"no token ends after byte {byte}")
        if not alive:
            return (here[-1], ((0, ()),)), here
        alive.append((0, here))
        if not settles:
            return (last, tuple(alive)), ()
        shared, k = min(len(p) for _, p in alive), 0
        while k < shared and all(p[k] == here[k] for _, p in alive):
            k += 1
        if not k:
            return (last, tuple(alive)), ()
        return (here[k - 1], tuple((n, p[k:]) for n, p in alive)), here[:k]

    def _walk(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces in order of falling length: their emissions, one for each byte and one for the end of each piece, and where those of each piece start."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw, source = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(length) - length
        start = source + np.arange(len(pieces))
        out, state = np.zeros(len(raw) + len(pieces), np.int32), np.zeros(len(pieces), np.int64)
        # The pieces that have a byte k are the first ones.
        wide = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right").tolist()
        for k, m in enumerate(wide):
            if m < NARROW:
                break
            if len(self.step) > self.kept:
                known, back = np.unique(state[:m], return_inverse=True)
                state[:m] = np.array(self._start_over([self.states[i] for i in known.tolist()]), np.int64)[back]
            codes, keys = pd.factorize(state[:m] << 8 | raw[source[:m] + k])
            got = np.fromiter(map(self.step.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
            new = np.flatnonzero(got < 0)
            if len(new):
                got[new] = [self._transition(x) for x in keys[new].tolist()]
            got = got[codes]
            state[:m] = np.frombuffer(self.to, np.int32)[got]
            out[start[:m] + k] = np.frombuffer(self.emits, np.int32)[got]
            over = slice(wide[k + 1] if k + 1 < len(wide) else 0, m)
            out[start[over] + k + 1] = [self._end(i) for i in state[over].tolist()]
        else:
            k, m = len(wide), 0
        for p in range(m):
            at, s = int(start[p]), int(state[p])
            for i in range(k, len(pieces[p])):
                if len(self.step) > self.kept:
                    s, *state[p + 1 : m] = self._start_over([self.states[x] for x in (s, *state[p + 1 : m].tolist())])
                t = self.step.get(s << 8 | pieces[p][i])
                if t is None:
                    t = self._transition(s << 8 | pieces[p][i])
                s = self.to[t]
                out[at + i] = self.emits[t]
            out[at + len(pieces[p])] = self._end(s)
        return out, start

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        got = [self.ranks.get(p, -1) for p in pieces]
        asked = sorted({p for p, i in zip(pieces, got, strict=True) if i < 0 and p}, key=len, reverse=True)
        ids: dict[bytes, bytes] = {b"": b""}
        if asked:
            if len(self.pool) > self.kept:
                self._forget_emitted()
                self._start_over([])
            out, start = self._walk(asked)
            many = np.frombuffer(self.many, np.int32)[out].astype(np.int64)
            flat = spread(np.frombuffer(self.pool, np.uint32), np.frombuffer(self.first, np.int64)[out], many).astype("<u4").tobytes()
            ends = [*(4 * (np.cumsum(many) - many)[start]).tolist(), len(flat)]
            ids |= zip(asked, (flat[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True)
        return [i.to_bytes(4, "little") if i >= 0 else ids[p] for p, i in zip(pieces, got, strict=True)]


class Splitter:
    """The pieces that the rank-file library's own regular expression engine finds: letters and numbers of newer Unicode versions than it knows count as neither."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).finditer
        self.newer: dict[int, str] | None = None

    def _load(self) -> dict[int, str]:
        import regex
        import tiktoken

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        bytes_only = {bytes([i]): i for i in range(256)}
        newer: dict[int, str] = {}
        for kind in (r"\p{L}", r"\p{N}"):
            known = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=bytes_only, special_tokens={})
            there = set(bytes(known.encode_ordinary(every)).decode())
            # The section sign stands for any character that is no letter, number or white space.
            newer |= {ord(c): "\u00a7" for c in regex.findall(kind, every) if c not in there}
        return newer

    def pieces(self, text: str) -> list[str]:
        seen = text
        if not text.isascii() and max(text) > "\u024f":
            if self.newer is None:
                self.newer = self._load()
            seen = text.translate(self.newer)
        return [text[m.start() : m.end()] for m in self.find(seen)]


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the characters that are complete; finish() raises ValueError if some are not.

    States are how many continuation bytes are missing and the range allowed for the next one (Unicode standard, table 3-7).
    """

    def __init__(self):
        self.missing, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def _byte(self, b: int) -> None:
        if self.missing:
            if not self.low <= b <= self.high:
                raise ValueError(f"byte {b:#x} can't continue a character")
            self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
        elif b >= 0x80:
            if not 0xC2 <= b <= 0xF4:
                raise ValueError(f"byte {b:#x} can't start a character")
            self.missing = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)

    def feed(self, data: bytes) -> str:
        """Only the last bytes need the states: what is complete before them is decoded at once."""
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                cut = len(data) - back
                break
            if b < 0x80:
                break
        self.missing, self.low, self.high = 0, 0x80, 0xBF
        tail = data[cut:]
        for b in tail:
            self._byte(b)
        if not self.missing:
            cut, tail = len(data), b""
        self.held = tail
        try:
            return data[:cut].decode()
        except UnicodeDecodeError as e:
            raise ValueError(str(e)) from e

    def finish(self) -> None:
        if self.held:
            raise ValueError("the text ends within a character")


class Codec:
    """Encodes whole texts and decodes streams of ids."""

    #: Ids that are decoded at a time.
    STREAM = 1 << 16

    def __init__(self, path: str, pattern: str, transitions: int = KEPT_TRANSITIONS):
        self.transducer = Transducer(read_ranks(path), transitions)
        self.split = Splitter(pattern).pieces
        self.chunks = BlankChunks(lambda words: self._cut(words, " "), lambda words: self._cut(words, "\n"), self._whole, "<u4")

    def _whole(self, text: str) -> bytes:
        return b"".join(self.transducer.encode_many([p.encode() for p in self.split(text)]))

    def _cut(self, words: list[str], space: str) -> list[bytes]:
        """Ids of words that follow that white space each; a piece that starts with it starts a word's ids."""
        if not words:
            return []
        pieces = self.split(space + space.join(words))
        codes, told = pd.factorize(np.array(pieces, object))
        ids = self.transducer.encode_many([p.encode() for p in told.tolist()])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        opens = np.fromiter((p[0] == space for p in told.tolist()), bool, len(told))[codes]
        ends = [*(np.cumsum(length[codes]) - length[codes])[opens].tolist(), int(length[codes].sum())]
        flat = b"".join(map(ids.__getitem__, codes.tolist()))
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return self.chunks.encode(texts)

    def decode(self, ids: np.ndarray) -> Iterator[tuple[bytes, str]]:
        """Bytes and complete characters of each stretch of the stream. Ids outside the vocabulary raise KeyError."""
        machine, of = Utf8Machine(), self.transducer.bytes_of.__getitem__
        for k in range(0, len(ids), self.STREAM):
            data = b"".join(map(of, ids[k : k + self.STREAM].tolist()))
            yield data, machine.feed(data)
        machine.finish()


def codec(path: str, pattern: str) -> Codec:
    return kept(("bpe", path, pattern), lambda: Codec(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, as binary) of each document's whole text; a null text is empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            got = [x.tobytes() for x in encoded_batch(c, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.large_binary()).cast(pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_chars long"


def _digests(c: Codec, doc_ids: pa.Array, every: Iterator[np.ndarray]) -> pa.RecordBatch:
    rows = []
    for ids in every:
        digest, n_bytes, n_chars = hashlib.sha256(), 0, 0
        for data, text in c.decode(ids):
            digest.update(data)
            n_bytes += len(data)
            n_chars += len(text)
        rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), digest.hexdigest(), n_bytes, n_chars))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], [f.split()[0] for f in DIGEST.split(", ")])


def decoded_digest(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document of encoded(): the number and digest of its ids, and digest, bytes and characters of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield _digests(c, batch.column(0), (np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)))

    return ids.mapInArrow(run, DIGEST)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decoded_digest(encoded(docs)) in one pass: a task has one worker with one vocabulary, and no ids travel between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield _digests(c, batch.column(0), encoded_batch(c, batch.column(1)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, DIGEST)


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path(VOCABULARY)
    return round_trip(table(spark, sf_dir, "documents"), path, P.PATTERN)


QUERIES = {"op6_bpe_transducer": op6_bpe_transducer}
