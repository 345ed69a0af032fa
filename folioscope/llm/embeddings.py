"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative per group.

A pair within the angle of the threshold can lie in two cells only if each vector is that close to the cells' bisecting plane. So a
vector goes to its own cell and, as a guest, to every cell whose bisector it is within reach of; each vector's links are counted in
its own cell, where all its partners are at home or guests. No pair is lost, whatever the centroids are; they only decide the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import components, forget, table, written

THRESHOLD = 0.98
#: Vectors that k-means is fitted on at most (those of smallest hash); every vector is assigned.
FIT_SAMPLE = 20_000
#: There are 1 + sqrt(vectors) / CELL_ROOT cells: a vector can be a guest in every cell where data has no clusters, so cells times vectors must stay
#: far below vectors squared, and the centroids, a broadcast, grow with the root alone.
CELL_ROOT = 32
#: Vectors to a block: a task compares two blocks.
BLOCK = 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; empty cells take the row that fits worst. Deterministic."""
    k = max(1, min(k, len(x)))
    c = x[np.random.RandomState(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        sims = x @ c.T
        at = sims.argmax(1)
        worst = np.argsort(sims[np.arange(len(x)), at])
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        norm = np.linalg.norm(new, axis=1)
        for j, row in zip(np.flatnonzero(norm < 1e-12), worst, strict=False):
            new[j], norm[j] = x[row], 1.0
        new /= norm[:, None]
        if np.allclose(new, c):
            break
        c = new
    return c


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, without overflow or underflow. Rows must be finite and not zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of each unit row, matrix of the cells that it goes to)."""
    sims = x @ centroids.T
    own = sims.argmax(1)
    gaps = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-30))
    reach = np.sqrt(1 - threshold**2) + 1e-7
    mine = sims[np.arange(len(x)), own]
    return own, (mine[:, None] - sims) / gaps[own] <= reach


def min_labels(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a bipartite hit matrix over ids left and right: for each the smallest id it reaches through hits."""
    most = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        # Ids on both sides are one node: they share the smaller label.
        ids, back = np.unique(np.concatenate([left, right]), return_inverse=True)
        low = np.full(len(ids), most)
        np.minimum.at(low, back, np.concatenate([a, b]))
        a, b = low[back[: len(left)]], low[back[len(left) :]]
        na = np.minimum(a, np.where(hits, b[None, :], most).min(1, initial=most))
        nb = np.minimum(b, np.where(hits, na[:, None], most).min(0, initial=most))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def links(rows: DataFrame, threshold: float = THRESHOLD, fit_sample: int = FIT_SAMPLE, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """n_links, component_id and kept of every row of (vec_id, embedding, label); other columns are dropped.

    Vectors are compared if their labels are equal and not null and their lengths are. Null, empty and zero vectors, those with null or
    non-finite components and rows without vec_id link with nothing. Exact copies are compared once and counted each. Rows that share a
    vec_id are vectors of their own, wherever they link. No rows give no rows. component_id is null where vec_id is.
    """
    spark = rows.sparkSession
    e = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0),
        F.lit(False),
    )
    keyed = e.withColumn("usable", usable).withColumn("k1", F.xxhash64("e")).withColumn("k2", F.xxhash64(F.reverse("e"), F.lit(1)))
    keyed = keyed.select("vec_id", "label", "usable", "k1", "k2", "e")
    distinct = keyed.where("usable").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"), F.first("e").alias("e"))
    # Vectors are told apart by content: rep numbers the contents of a label.
    distinct = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    if cells is None:
        cells = 1 + -(-int(distinct.count() ** 0.5) // CELL_ROOT)
    sample = [np.array(r.e) for r in distinct.orderBy(F.xxhash64("k1", "label"), "k1", "k2").limit(fit_sample).select("e").collect()]
    centroids = {}
    for dim in {len(x) for x in sample}:
        centroids[dim] = spherical_kmeans(unit_rows(np.stack([x for x in sample if len(x) == dim])), cells)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rep, m = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            e = batch.column(3)
            size = np.diff(e.offsets.to_numpy())
            flat = np.asarray(e.flatten())
            first = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = unit_rows(flat[first[at][:, None] + np.arange(dim)])
                c = shared.value.get(int(dim))
                own, to = (np.zeros(len(x), int), np.ones((len(x), 1), bool)) if c is None else cells_of(x, c, threshold)
                row, cell = np.nonzero(to)
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [label.take(pa.array(at[row])), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(own[row] == cell), pa.array(rep[at[row]]), pa.array(m[at[row]]), packed.take(pa.array(row))],
                    ["label", "dim", "cell", "home", "rep", "m", "v"],
                )

    kind = distinct.schema["label"].dataType.simpleString()
    placed = distinct.select("label", "rep", "m", "e").mapInArrow(assign, f"label {kind}, dim int, cell int, home boolean, rep long, m long, v binary")
    placed = written(placed, "cells")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    here = placed.join(sizes, key).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A block of a cell's own vectors meets each block of all that is in the cell.
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = here.where("home").select(*key, F.col("b").alias("i"), each.alias("j"), F.lit(True).alias("asks"), "rep", "m", "v")
    answers = here.select(*key, each.alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"), "rep", "m", "v")

    def compare(key, t):
        t = t.combine_chunks()
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        dim = key[1].as_py()
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, dim)
        rep, m = t.column("rep").to_numpy(), t.column("m").to_numpy()
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        hits = v[a] @ v[b].T >= threshold
        same = rep[a][:, None] == rep[b][None, :]
        found = (hits * m[b][None, :]).sum(1) - (hits & same).sum(1)
        # A vector always links with its own copies, whatever the rounding.
        found += ((same & ~hits) * (m[b] - 1)[None, :]).sum(1)
        low, low_b = min_labels(hits, rep[a], rep[b])
        nodes, first = np.unique(np.concatenate([rep[a], rep[b]]), return_index=True)
        lows = np.concatenate([low, low_b])[first]
        joined = lows != nodes
        return pa.table(
            {
                "rep": np.concatenate([rep[a], nodes[joined]]),
                "n": np.concatenate([found, np.zeros(int(joined.sum()), np.int64)]).astype(np.int64),
                "low": pa.array(np.concatenate([rep[a], lows[joined]])),
            }
        )

    met = asks.unionByName(answers).groupBy(*key, "i", "j").applyInArrow(compare, "rep long, n long, low long")
    met = written(met.groupBy("rep", "low").agg(F.sum("n").alias("n")), "met")
    groups = components(met.where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnsRenamed({"node": "rep", "component": "c"})
    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    # Copies hang on their representative by content; a group of any size is one small row here.
    reps = written(distinct.select("label", "k1", "k2", "rep", "low").join(counts, "rep", "left").join(groups, "rep", "left").withColumn("c", F.coalesce("c", "rep")), "reps")
    reps = reps.join(reps.groupBy("c").agg(F.min("low").alias("least")), "c").select("label", "k1", "k2", "n", "least")
    forget(placed)
    alone = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    others = keyed.where("usable").select("vec_id", "label", "k1", "k2").join(reps, ["label", "k1", "k2"]).select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    return others.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_near_duplicates": op9_embedding_near_duplicates}
