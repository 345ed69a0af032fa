"""The pipeline's stages on made documents."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from folioscope.llm import packing, pieces  # noqa: E402
from tests.llm.test_jaccard import shingle_words  # noqa: E402


def made(folder, spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ing", "st"]) for _ in range(r.randrange(1, 5)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(r.randrange(20, 120))]
        toxic = i % 6 == 0
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["vile", "nasty"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1] + " " + word(), "en", "s", 1) for i in range(1, 300, 10)]
    rows += [(2000, "&&& $$$ %%%", "en", "s", 1), (2001, None, None, None, None), (2002, "", "en", "s", 0), rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, dict((d, t) for d, _, t in labels)


def test_stages(spark, tmp_path):
    rows, toxic = made(tmp_path, spark)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs)
        if k < 3:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    clean = [i for i, t in toxic.items() if not t]
    assert not {2000, 2001, 2002} & set(ids[0]) and len(ids[0]) >= 0.97 * (len(rows) - 3)
    assert sum(i in ids[1] for i in clean) >= 0.95 * len(clean) and sum(i in ids[1] for i, t in toxic.items() if t) <= 3
    assert len(ids[2]) == len(set(ids[2])) and not [i for i in ids[2] if i >= 1000 and i - 1000 in ids[1]]
    assert set(ids[3]) == set(ids[2])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids[3]
    by_hand(seen)


def by_hand(seen):
    """Each stage's rows from the rows before it, in plain Python: groups of near copies by all pairs, sequences by the library's ids."""
    left = text = {r.doc_id: r.text for r in seen[1].collect()}
    low = dict(zip(sorted(left), groups(sorted(left.items())), strict=True))
    assert {r.doc_id for r in seen[2].collect()} == {i for i in left if low[i] == i}
    whole = pieces.load(P.path(packing.VOCABULARY))
    spans: dict = {}
    sequences: dict = {}
    for r in seen[3].collect():
        ids = [*whole.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        spans.setdefault(r.doc_id, []).append((r.start, r.length, len(ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, total in ((sorted(p), p[0][2]) for p in spans.values()):
        assert [a for a, *_ in parts] == list(np.cumsum([0] + [n for _, n, _ in parts])[:-1]) and sum(n for _, n, _ in parts) == total
    for parts in map(sorted, sequences.values()):
        assert [a for a, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 4096


def groups(rows):
    """The smallest id of each row's group, by comparing all pairs."""
    sets, up = [shingle_words(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                a_, b_ = root(i), root(j)
                up[max(a_, b_)] = min(a_, b_)
    return [rows[root(i)][0] for i in range(len(rows))]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_and_missing_labels(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", None, "s", 1), (2, "", "en", "s", 0), (None, "x y z", "en", None, None), (1, "a a", "en", "s", 3)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
    # Without labels only the empty text goes; of two rows of an id the one of smaller text stays.
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, "x y z"), (1, "a a")]


def test_clashing_columns(spark, tmp_path):
    made(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(40).selectExpr("*", "1 AS Score", "'p' AS perplexity", "map('k', 1) AS `a``b`", "2 AS limit", "3 AS component_id", "4 AS _text", "true AS predicted")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Score", "perplexity", "a`b", "limit", "component_id", "_text", "predicted"]
    assert docs.count() > 20
