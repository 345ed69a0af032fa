"""Token operators against the libraries and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from folioscope.llm import packing, pieces, wavelet  # noqa: E402

TEXTS = ["", " ", "a", " a", "a ", "a\n", "\na", "\n\na b", "a  b", "a \n b", "don't We'Ll  x's, it's.", "Üben ñandú, ça va. Été\n\n\nfin", "a\tb c  d", "x y z", "tokens...!!! 12,345.67 ²½", "日本語 テキスト。混ざる", "éclair ñ", "<|endoftext|> <|startoftext|>", "\x1c\x1d a \x85b", "ΣΑΣ σας", "İstanbul", "word,\nnext. Line", "a.\nB, c", "👩‍👩‍👧 family", "long" * 2000, "1 2 3\n4"]


@pytest.mark.parametrize("kind,name", [(pieces.ByteLevelEncoder, "byte_bpe_50k.json"), (pieces.FoldedWordEncoder, "word_bpe_49k.json")])
def test_chunks_give_the_librarys_ids(kind, name):
    whole = pieces.load(P.path(name))
    e = kind(P.path(name), limit=400)
    r = random.Random(5)
    made = ["".join(r.choice(["ab", "Z", " ", "  ", "\n", ".", ",", "'s", "é", "9", "\t", " ", "!", "ß"]) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    made += ["".join(r.choice(["İ", "ŉ", "ǆ", "|", ".", ",", " ", " ", "a", "e\u0301", "\u0301", "µ"]) for _ in range(r.randrange(1, 12))) for _ in range(2000)]
    every = TEXTS + made + TEXTS
    for k in range(0, len(every), 700):
        some = every[k : k + 700]
        for text, ids in zip(some, e.encode(pa.array(some)), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert [x.tolist() for x in pieces.encoded_batch(e, pa.array([None, "a b", ""]))] == [[], whole.encode("a b", add_special_tokens=False).ids, []]


def brute_first_fit(lengths, capacity):
    rooms, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, room in enumerate(rooms) if room >= lengths[i]), None)
        if b is None:
            b = len(rooms)
            rooms.append(capacity)
        out[i] = (b, capacity - rooms[b])
        rooms[b] -= lengths[i]
    return out


def test_tournament_is_first_fit_decreasing():
    r = random.Random(1)
    for n in [*range(1, 12), 200]:
        lengths = [r.randrange(1, 101) for _ in range(n)]
        assert packing.first_fit_decreasing(lengths, 100) == brute_first_fit(lengths, 100)
    assert packing.first_fit_decreasing([], 100) == []
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([101], 100)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, start long")


ROWS = [(7, t, "en", 1) for t in TEXTS[:4]] + [(i + 10, t, None, 2) for i, t in enumerate(TEXTS)] + [(3, None, None, None), (None, "no id", None, None), (7, "a", "en", 1), (-(1 << 63), "least", None, None)]


def test_packed_pieces_cover_every_id(spark):
    path = P.path(packing.VOCABULARY)
    got = packing.pack(packing.written(packing.token_pieces(frame(spark, ROWS), path, 64), "t"), 64, 8).collect()
    whole = pieces.load(path)
    want = [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in ROWS]
    known = lambda r: (r[0] is not None, r)
    expect = sorted(((d, s, len(x := ids[s : s + 64]), zlib.crc32(np.array(x, "<u4").tobytes()), len(ids)) for d, ids in want for s in range(0, len(ids), 64)), key=known)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=known) == expect
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64


def test_packing_of_nothing(spark):
    assert packing.pack(packing.token_pieces(frame(spark, []), P.path(packing.VOCABULARY))).count() == 0


def test_wavelet_matrix_answers():
    r = np.random.RandomState(3)
    for n in (0, 1, 511, 512, 513, 3000):
        t = r.randint(0, 300, n)
        t[: n // 3] = 7
        m = wavelet.WaveletMatrix(wavelet.build(t, [5, 6], [n // 2, n - n // 2]))
        assert m.tokens().tolist() == t.tolist()
        for i in range(0, n, 37):
            assert m.access(i) == t[i]
            assert m.rank(int(t[i]), i) == int((t[:i] == t[i]).sum())
        assert m.occurrences(7) == np.flatnonzero(t == 7).tolist()
        assert m.count(299) == int((t == 299).sum()) and m.count(1 << 20) == 0
    with pytest.raises(ValueError):
        wavelet.build(np.array([1 << 16]), [1], [1])
    with pytest.raises(ValueError):
        wavelet.build(np.array([1]), [1], [2])
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(IndexError):
        m.select(7, m.count(7))
    t = r.randint(0, 5, 5000)
    m = wavelet.WaveletMatrix(wavelet.build(t, [None, -(1 << 63)], [4999, 1]))
    assert m.null.tolist() == [True, False] and m.doc_ids[1] == -(1 << 63)
    at = np.arange(5001)
    for token in range(6):
        assert (m.rank_many(token, at) == np.concatenate([[0], np.cumsum(t == token)])).all()
        assert m.occurrences(token) == np.flatnonzero(t == token).tolist()
    assert (m.access_many(at[:-1]) == t).all()


def test_wavelet_shards_round_trip(spark):
    path = P.path(wavelet.VOCABULARY)
    stored = wavelet.written(wavelet.shards(frame(spark, ROWS), path, shard_tokens=50), "w")
    got = wavelet.documents_of(stored).collect()
    whole = pieces.load(path)
    at, want = 0, []
    for d, t in sorted(((r[0], r[1]) for r in ROWS), key=lambda x: (x[0] if x[0] is not None else -(1 << 70), x[1] is not None, (x[1] or "").encode())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda x: x[1]
    assert [tuple(r)[:4] for r in sorted(got, key=key)] == want
    assert stored.count() > 3


def test_wavelet_of_nothing(spark):
    assert wavelet.documents_of(wavelet.written(wavelet.shards(frame(spark, []), P.path(wavelet.VOCABULARY)), "w")).count() == 0


def test_new_chunks_are_objects_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(pieces, "OBJECTS", 4)
    asked = []

    def encode(words):
        asked.append(len(words))
        return [np.arange(len(w), dtype="<u2").tobytes() for w in words]

    r = pieces.Remembered(encode, "<u2")
    words = pa.array(["a" * k for k in range(1, 11)])
    place = r.places(words)
    assert asked == [4, 4, 2]
    assert r.length[place].tolist() == list(range(1, 11)) and pieces.spread(r.pool, r.start[place], r.length[place]).tolist() == [i for k in range(1, 11) for i in range(k)]
    assert (r.places(words) == place).all() and asked == [4, 4, 2]


def test_packing_takes_half_of_what_the_encoders_may_take():
    assert packing.PORTION * 2 <= pieces.PORTION and packing.REMEMBERED * 2 <= pieces.REMEMBERED
