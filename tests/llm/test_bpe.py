"""The transducer against the definition and the rank-file library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from folioscope.llm import bpe  # noqa: E402
from tests.llm.test_tokens import ROWS, TEXTS, frame  # noqa: E402

PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_as_the_library(library):
    c = bpe.codec(PATH, P.PATTERN)
    r = random.Random(2)
    alphabet = ["th", "e", "ing", "Z", " ", "  ", "\n", ".", ",", "'s", "é", "ción", "9", "\t", "!", "ß", "日", "\u0558", "\U0001f469", "\u200d", "\x1c"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(4000)]
    made += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(128, 0x2FF), r.randrange(0x300, 0xD000), r.randrange(0x10000, 0x1FFFF)])) for _ in range(12)) for _ in range(2000)]
    every = TEXTS + made + ["".join(r.choice("abcdefghijklmnop") for _ in range(30_000))]
    for text, got in zip(every, c.encode(pa.array(every)), strict=True):
        assert got.tolist() == library.encode_ordinary(text), repr(text)
        assert "".join(t for _, t in c.decode(got)) == text


def test_transducer_is_the_definition():
    r = random.Random(4)
    for _ in range(30):
        # Small vocabularies, every token of which merges from two others.
        tokens = [bytes([x]) for x in b"abc"]
        while len(tokens) < 14:
            x = r.choice(tokens) + r.choice(tokens)
            if x not in tokens and len(x) < 7:
                tokens.append(x)
        ranks = {t: i for i, t in enumerate(tokens)}
        t = bpe.Transducer(ranks, kept=50)
        for n in (1, 5, 200):
            pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 20))) for _ in range(n)]
            for piece, got in zip(pieces, t.encode_many(pieces), strict=True):
                want = [ranks[piece]] if piece in ranks else bpe.merge(piece, ranks)
                assert np.frombuffer(got, "<u4").tolist() == want
            # A piece of each length may make as many transitions beyond the limit as go side by side.
            assert len(t.step) <= 50 + n


def test_utf8_machine():
    text = "aß日👩 é\n" * 3
    data = text.encode()
    for size in range(1, 9):
        m = bpe.Utf8Machine()
        assert "".join(m.feed(data[k : k + size]) for k in range(0, len(data), size)) == text
        m.finish()
    for bad in (b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xe0\x80\x80", b"\xf4\x90", b"a\x80", b"\xe3\x81a"):
        m = bpe.Utf8Machine()
        with pytest.raises(ValueError):
            m.feed(bad)
            m.finish()


def test_query_rows(spark, library):
    got = {(r.doc_id, r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in bpe.decoded_digest(bpe.encoded(frame(spark, ROWS), PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    want = set()
    for d, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        want.add((d, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert {(r.doc_id, r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(frame(spark, ROWS), PATH, P.PATTERN).collect()} == want
    assert bpe.decoded_digest(bpe.encoded(frame(spark, []), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0
