"""Token ids of whole texts, many texts at a time: white-space-delimited chunks are told apart by Arrow, and only distinct ones are encoded.

A chunk is a run of other characters together with the one blank or line break before it. The vocabularies cut a text right before a
single white space that follows another character, so encoding chunks apart gives the ids of the whole text. Texts where that
doesn't hold (white space in a row, at an end, or of another kind) are encoded whole, if the vocabulary keeps white space.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts that are taken at a time (a longer text is taken whole), and bytes that remembered chunks may take.
PORTION, REMEMBERED = 1 << 23, 40 << 20
#: Words that the library gets at a time, and new chunks that are Python objects at a time.
TOGETHER, OBJECTS = 128, 1 << 16
#: White space other than line feeds.
SPACES = r"[\t\x0b-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


class Remembered:
    """Ids of chunks, in flat arrays: about 30 bytes a chunk. Beyond the limit in bytes only the chunks of the last portion are kept."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kind: str, limit: int = REMEMBERED):
        self.encode, self.kind, self.limit = encode, np.dtype(kind), limit
        self.words = pa.array([], pa.string())
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place in start and length of each of distinct words; they hold until the next call."""
        if self.words.nbytes + self.start.nbytes * 2 + self.pool.nbytes > self.limit:
            self._keep(words)
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        if new.any():
            more = words.filter(pa.array(new))
            lengths, pools = [], []
            for k in range(0, len(more), OBJECTS):
                got = self.encode(more.slice(k, OBJECTS).to_pylist())
                lengths.append(np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize)
                pools.append(np.frombuffer(b"".join(got), self.kind))
            length = np.concatenate(lengths)
            at[new] = len(self.words) + np.arange(len(length))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.pool = np.concatenate([self.pool, *pools])
            self.words = pa.concat_arrays([self.words, more])
        return at

    def _keep(self, words: pa.Array) -> None:
        keep = np.flatnonzero(pc.is_in(self.words, value_set=words).to_numpy(zero_copy_only=False))
        length = self.length[keep]
        self.pool = spread(self.pool, self.start[keep], length)
        self.words, self.length, self.start = self.words.take(pa.array(keep)), length, np.cumsum(length) - length


def spread(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of pool that start and length say, one after the other."""
    before = np.cumsum(length) - length
    at = np.repeat(start - before, length)
    at += np.arange(len(at))
    return pool[at]


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first chunk of each text, code of each chunk, distinct chunks). Chunks are parted by single blanks; a line break starts one."""
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    offsets = cut.offsets.to_numpy().astype(np.int64)
    told = cut.flatten().dictionary_encode()
    return offsets - offsets[0], told.indices.to_numpy().astype(np.int64), told.dictionary


def _taken(pool: np.ndarray, start: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of texts given by offsets of chunks the ids, where chunks are stretches of pool."""
    flat = spread(pool, start, length)
    ends = np.concatenate([[0], np.cumsum(length)])[offsets].tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class BlankChunks:
    """Ids of texts for a vocabulary that keeps white space.

    words(list) gives the packed ids of words that follow a blank each, lines(list) those of words that follow a line break each, and
    whole(text) those of any text; kind is the ids' numpy type.
    """

    def __init__(self, words, lines, whole, kind: str, limit: int = REMEMBERED):
        self.words, self.lines, self.whole, self.kind = Remembered(words, kind, limit), Remembered(lines, kind, limit // 4), whole, kind
        self.line_break = len(whole("\n")) // np.dtype(kind).itemsize

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        offsets, codes, chunks = split(texts)
        first, n = offsets[:-1], len(chunks)
        flags = lambda x: x.to_numpy(zero_copy_only=False)
        size, broken, spaced = flags(pc.binary_length(chunks)), flags(pc.starts_with(chunks, "\n")), flags(pc.match_substring_regex(chunks, SPACES))
        odd = spaced | (size <= broken)
        # The first chunk of a text follows nothing; if it is empty, the text starts with white space or is empty.
        starts, opens = np.unique(codes[first], return_inverse=True)
        strange = odd[codes]
        strange[first] = spaced[codes[first]]
        whole = np.logical_or.reduceat(strange, first)
        used, later = np.zeros(n, bool), np.ones(len(codes), bool)
        later[first] = False
        used[codes[later]] = True
        start, length = np.zeros(n + len(starts), np.int64), np.zeros(n + len(starts), np.int64)
        blank, lines, bare = np.flatnonzero(used & ~odd & ~broken), np.flatnonzero(used & ~odd & broken), np.flatnonzero(~odd[starts])
        asked = pa.concat_arrays([pc.utf8_slice_codeunits(chunks.take(pa.array(lines)), 1), chunks.take(pa.array(starts[bare]))]).dictionary_encode()
        place = self.words.places(chunks.take(pa.array(blank)))
        start[blank], length[blank] = self.words.start[place], self.words.length[place]
        place = self.lines.places(asked.dictionary)[asked.indices.to_numpy()]
        base = len(self.words.pool)
        start[lines], length[lines] = base + self.lines.start[place[: len(lines)]], self.lines.length[place[: len(lines)]]
        start[n + bare], length[n + bare] = base + self.lines.start[place[len(lines) :]] + self.line_break, self.lines.length[place[len(lines) :]] - self.line_break
        codes[first] = n + opens
        out = _taken(np.concatenate([self.words.pool, self.lines.pool]), start[codes], length[codes], offsets)
        for k in np.flatnonzero(whole):
            out[k] = np.frombuffer(self.whole(texts[int(k)].as_py()), self.kind)
        return out


def stretches(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """ids cut where starts is true, packed."""
    cut, raw, k = np.flatnonzero(starts), ids.tobytes(), ids.itemsize
    ends = [*(cut * k).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _together(t, text: str, kind: str) -> np.ndarray:
    return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)


def _marked(word: str) -> bool:
    """Latin letters and a closing mark: the mark is a piece of its own, and each has the ids that it has alone after the same white space."""
    return word[-1:] in (".", ",") and len(word) > 1 and word[:-1].isalpha() and max(word) < "ɐ"


class ByteLevelEncoder(BlankChunks):
    """The byte-level vocabulary of the tokenizers library: ids as unsigned 16-bit integers."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.t = load(path)
        self.blank = np.array([self.t.id_to_token(i)[:1] == "Ġ" for i in range(self.t.get_vocab_size())])
        self.mark = {m: _together(self.t, m, "<u2").tobytes() for m in ".,"}
        (self.newline,) = _together(self.t, "\n", "<u2")
        super().__init__(self._words, self._lines, lambda text: _together(self.t, text, "<u2").tobytes(), "<u2", limit)

    def _unmarked(self, words: list[str], of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """What of() gives for words, without their closing marks and once each."""
        bare = [w[:-1] if _marked(w) else w for w in words]
        every = list(dict.fromkeys(bare))
        got = dict(zip(every, (x for k in range(0, len(every), TOGETHER) for x in of(every[k : k + TOGETHER])), strict=True))
        return [got[b] if len(b) == len(w) else got[b] + self.mark[w[-1]] for b, w in zip(bare, words, strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        def of(some: list[str]) -> list[bytes]:
            ids = _together(self.t, " " + " ".join(some), "<u2")
            return stretches(ids, self.blank[ids])

        return self._unmarked(words, of)

    def _lines(self, words: list[str]) -> list[bytes]:
        def of(some: list[str]) -> list[bytes]:
            ids = _together(self.t, "\n" + "\n".join(some), "<u2")
            return stretches(ids, ids == self.newline)

        return self._unmarked(words, of)


class FoldedWordEncoder:
    """The lower-case word vocabulary, which drops white space, so that any blank or line break parts chunks and none is strange."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.t = load(path)
        self.ends = np.array([self.t.id_to_token(i)[-4:] == "</w>" for i in range(self.t.get_vocab_size())])
        self.mark = {m: _together(self.t, m, "<u2").tobytes() for m in ".,|"}
        self.remembered = Remembered(self._words, "<u2", limit)

    def _words(self, words: list[str]) -> list[bytes]:
        # Latin-1 letters are in the library's normal form, and it folds their case as Python does.
        low = [w.lower() if w and max(w) < "Ā" else w for w in words]
        bare = [w[:-1] if _marked(w) and max(w) < "Ā" else w for w in low]
        got, bar = {"": b""}, np.frombuffer(self.mark["|"], "<u2")[0]
        every = [w for w in dict.fromkeys(bare) if w]
        # Words of letters alone are one piece, with a mark at its end; others are set apart by bars.
        letters = [w for w in every if w.isalpha() and max(w) < "Ā"]
        for k in range(0, len(letters), TOGETHER):
            some = letters[k : k + TOGETHER]
            ids = _together(self.t, " ".join(some), "<u2")
            got |= zip(some, stretches(ids, np.concatenate([[True], self.ends[ids][:-1]])), strict=True)
        plain = [w for w in every if w not in got and "|" not in w]
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            ids = _together(self.t, "| " + " | ".join(some), "<u2")
            got |= zip(some, (x[2:] for x in stretches(ids, ids == bar)), strict=True)
        for w in every:
            if w not in got:
                got[w] = _together(self.t, w, "<u2").tobytes()
        return [got[b] if len(b) == len(w) else got[b] + self.mark[w[-1]] for b, w in zip(bare, low, strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        told = cut.flatten().dictionary_encode()
        place = self.remembered.places(told.dictionary)[told.indices.to_numpy()]
        r = self.remembered
        return _taken(r.pool, r.start[place], r.length[place], offsets - offsets[0])


def portions(texts: pa.Array, characters: int = PORTION) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first, texts) of about so many bytes each."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + characters, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def encoded_batch(encoder, texts: pa.Array, characters: int = PORTION) -> Iterator[np.ndarray]:
    """The ids of each text, in order, from texts of any number and length; null texts are empty."""
    texts = pc.fill_null(pa.array(texts.to_pylist(), pa.string()) if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.string()), "")
    for _, some in portions(texts, characters):
        yield from encoder.encode(some)
