"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from folioscope.llm import jaccard, shingles
from tests.llm.test_tokens import ROWS, frame


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_words(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_words(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0), len(s), low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    rows = [*ROWS]
    for i in range(60):
        w = [word() for _ in range(r.choice([3, 5, 6, 30, 80, 120]))]
        if r.random() < 0.5:
            at = r.randrange(len(w))
            w[at:at] = passage
        rows.append((1000 + i * 10, " ".join(w), "en", i))
        for k in range(r.choice([0, 0, 1, 3])):
            # Chains of edits, so that some copies are close to the limit.
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = word()
            rows.append((1001 + i * 10 + k, r.choice([" ", "\n", "  "]).join(w).upper() if k == 2 else " ".join(w), None, 0))
    # A large family of different texts.
    base = [word() for _ in range(100)]
    for k in range(80):
        w = [*base]
        w[r.randrange(100)] = word() + str(k)
        rows.append((5000 + k, " ".join(w), "de", 0))
    rows += [(6000, " ".join(base * 30), "de", 0), (6001, " ".join(base * 30) + " x", "de", 0), (6002, "a " * 3000, "de", 0)]
    return rows


@pytest.mark.parametrize("seed,block,share,paired", [(1, 4096, 0.002, 12), (2, 9, 0.05, 3), (3, 4096, 0.02, 1)])
def test_components(spark, seed, block, share, paired):
    rows = corpus(seed)
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.n_shingles, x.component_id) for x in jaccard.joined(frame(spark, rows).repartition(3), block, share, paired).collect())
    assert got == brute(rows)


def test_nothing(spark):
    assert jaccard.joined(frame(spark, [])).count() == 0
    assert jaccard.joined(frame(spark, [(1, None, None, None), (2, " \n", None, None)])).count() == 2


def test_shingle_hashes_are_sets_of_words():
    r = random.Random(3)
    seen = {}
    for _ in range(3000):
        text = "".join(r.choice(["a", "B", "b", " ", "\t", "é", "\xa0", "cd", "\n"]) for _ in range(r.randrange(0, 25)))
        got, want = tuple(shingles.shingle_set(text).tolist()), frozenset(shingle_words(text))
        assert len(got) == len(want)
        assert seen.setdefault(want, got) == got
    assert len(set(seen.values())) == len(seen)


def test_tree_is_all_pairs():
    r = np.random.RandomState(5)
    base = [r.randint(0, 2**62, 150).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(300):
        b = base[r.randint(6)]
        keep = b[r.rand(len(b)) > r.choice([0.02, 0.1, 0.3, 0.8])]
        sets.append(np.unique(np.concatenate([keep, r.randint(0, 2**62, r.randint(0, 12)).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    link = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= jaccard.needed(int(sizes[i]), int(sizes[j]))
    maps = [jaccard.bitmap(s, jaccard.bitmap_bits(len(s))) for s in sets]
    for side in (None, r.randint(0, 2, 300)):
        g = jaccard.grouped(sizes, maps, link, side)
        want = jaccard.Groups(300)
        for i in range(300):
            for j in range(i):
                if (side is None or side[i] != side[j]) and link(i, j):
                    want.join(i, j)
        assert [g.root(i) for i in range(300)] == [want.root(i) for i in range(300)]
