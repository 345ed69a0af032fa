"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from folioscope.llm import embeddings
from folioscope.llm.common import components


def brute(rows, threshold):
    usable = [i for i, (k, e, label) in enumerate(rows) if k is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(usable):
        for j in usable[:x]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0), n[i], low.get(find(i)), r[0] is not None and r[0] == low[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("cells,block", [(None, 4096), (20, 4096), (6, 7), (1, 4096)])
def test_all_links(spark, cells, block):
    r = np.random.RandomState(cells or 0)
    centres = r.normal(size=(14, 5))
    made = []
    for i in range(230):
        made.append((i * 3, [float(np.float32(x)) for x in centres[r.randint(14)] + r.normal(size=5) * r.choice([0.0, 0.03, 0.12])], int(r.randint(3))))
    made += [(1000 + i, made[5][1], made[5][2]) for i in range(30)] + [(2000, [2 * x for x in made[5][1]], made[5][2]), made[7]]
    made += [(3001, None, 1), (3002, [0.0] * 5, 1), (3003, [float("nan")] * 5, 1), (3004, [1.0, None, 1.0, 1.0, 1.0], 1), (3005, made[5][1], None), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (None, made[5][1], 1), (3009, [float("inf")] * 5, 1)]
    df = spark.createDataFrame([(*x, "clash") for x in made], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = sorted(((x.vec_id is None, x.vec_id or 0), x.n_links, x.component_id, x.kept) for x in embeddings.links(df, cells=cells, block=block).collect())
    assert got == brute(made, embeddings.THRESHOLD)


@pytest.mark.parametrize("rows", [[(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0])], [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001])], [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [1.0, 0.01]), (5, [0.0, 1.0])]])
def test_rows_that_share_an_id(spark, rows):
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(((x.vec_id is None, x.vec_id or 0), x.n_links, x.component_id, x.kept) for x in embeddings.links(df).collect())
    assert got == brute([(*x, 1) for x in rows], embeddings.THRESHOLD)


def test_nothing(spark):
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    r = np.random.RandomState(1)
    edges = [(int(a), int(b)) for a, b in r.randint(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(60)] + [(500, 300 + i) for i in range(100)] + [(5, 5), (None, 3)]
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in low} == low and set(got) <= set(low)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
