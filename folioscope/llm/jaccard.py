"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets form a class, and classes are joined. Two linked classes share one of the first shingles of both
in any fixed order of all shingles (prefix filter). The order puts very common shingles last, so that common passages bring few
documents together. Classes that share such a key meet in a signature tree: its nodes hold OR-combined shingle bitmaps and size
ranges, and the dual traversal drops pairs of nodes whose largest possible overlap is too small, and pairs that are in one group
already. What is left connects classes to possible groups; within each, a second tree finds the links by their whole sets, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import components, forget, table, text_or_empty, written
from folioscope.llm.shingles import shingle_set

WORDS = 5
#: A shingle counts as common if more than this share of all documents has it, seen from the tasks where that holds. It only orders.
COMMON_SHARE = 0.002
#: Largest number of common shingles that is broadcast (8 bytes each); if more qualify, the most frequent are taken.
MOST_COMMON = 400_000
#: Members of a key or a possible group that one task compares; larger ones are dealt as pairs of blocks.
BLOCK = 4096
BITMAP_BITS = (8, 32768)
#: Keys of so many classes at most give pairs right away, which are counted over all keys; larger ones get a signature tree each.
PAIRED = 12
LEAF = 32


def needed(a, b):
    """Smallest overlap of sets of sizes a and b with 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def bitmap_bits(n: int) -> int:
    """A power of two of about the set's size: 0.75 to 1.5 bits a shingle."""
    return int(min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << max(0, int(1.5 * n).bit_length() - 1))))


def bitmap(shingles: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, np.uint8)
    out[(shingles >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of rows brought down to width bytes: halves are combined by OR."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


class Groups:
    """Union-find over places; the root is the smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Node:
    __slots__ = ("bits", "children", "clash", "high", "low", "members", "one")

    def __init__(self, bits, low, high, clash, members=None, children=()):
        self.bits, self.low, self.high, self.clash, self.members, self.children, self.one = bits, low, high, clash, members, children, False


class SignatureTree:
    """Over sets given by size, bitmaps of one width and place in groups; link(i, j) says whether two that may be linked are.

    unlike: arrays of sides; sets are compared only if they are on other sides in each.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, places: np.ndarray, groups: Groups, link: Callable[[int, int], bool] | None, unlike=()):
        self.sizes, self.link, self.unlike, self.places, self.groups = sizes, link, unlike, places.tolist(), groups
        width = bits.shape[1]
        self.words = np.ascontiguousarray(bits).view(np.uint8 if width < 8 else np.uint64).reshape(len(bits), -1)
        self.clash = sizes - np.bitwise_count(self.words).sum(1).astype(np.int64)
        # Alike sets side by side: by size class, then by the lowest bits set.
        order = np.lexsort((*(self.words[:, k] for k in range(min(2, self.words.shape[1]))), np.floor(np.log(sizes) / np.log(1.25))))
        level = [self._leaf(order[k : k + LEAF]) for k in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._over(level[k : k + 8]) for k in range(0, len(level), 8)]
        self.top = level[0]

    def _leaf(self, at: np.ndarray) -> Node:
        return Node(np.bitwise_or.reduce(self.words[at], 0), int(self.sizes[at].min()), int(self.sizes[at].max()), int(self.clash[at].max()), at)

    def _over(self, nodes: list[Node]) -> Node:
        return Node(np.bitwise_or.reduce([n.bits for n in nodes], 0), min(n.low for n in nodes), max(n.high for n in nodes), max(n.clash for n in nodes), None, nodes)

    def _may(self, x: Node, y: Node) -> bool:
        """Sizes can fit, and the overlap can be large enough: shared bits and what clashes on one bit bound it."""
        if 5 * x.high < 4 * y.low or 5 * y.high < 4 * x.low:
            return False
        most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.clash, y.clash)
        return most >= needed(x.low, y.low)

    def _same(self, x: Node) -> int | None:
        """The group that all of x is in, or None."""
        if x.one is not False and x.one is not None:
            return self.groups.root(x.one)
        if x.members is None:
            roots = set()
            for c in x.children:
                r = self._same(c)
                if r is None:
                    return None
                roots.add(r)
        else:
            roots = {self.groups.root(self.places[i]) for i in x.members.tolist()}
        if len(roots) > 1:
            return None
        x.one = roots.pop()
        return x.one

    def run(self) -> None:
        # Within leaves first: then whole nodes are soon in one group.
        todo = [self.top]
        leaves = []
        while todo:
            n = todo.pop()
            if n.members is None:
                todo += n.children
            else:
                leaves.append(n)
        for n in leaves:
            self._leaves(n, n)
        self._within(self.top)

    def _within(self, x: Node) -> None:
        if x.members is not None or self._same(x) is not None:
            return
        for c in x.children:
            self._within(c)
        for k, a in enumerate(x.children):
            for b in x.children[k + 1 :]:
                self._between(a, b)

    def _between(self, x: Node, y: Node) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if not self._may(x, y):
                continue
            r = self._same(x)
            if r is not None and r == self._same(y):
                continue
            if x.members is not None and y.members is not None:
                self._leaves(x, y)
            elif y.members is not None or (x.members is None and x.high - x.low > y.high - y.low):
                todo += [(c, y) for c in x.children]
            else:
                todo += [(x, c) for c in y.children]

    def _leaves(self, x: Node, y: Node) -> None:
        a, b = x.members, y.members
        wa, wb, na, nb = self.words[a], self.words[b], self.sizes[a], self.sizes[b]
        common = np.bitwise_count(wa[:, None, :] & wb[None, :, :]).sum(2).astype(np.int64)
        most = common + np.minimum(self.clash[a][:, None], self.clash[b][None, :])
        most = np.minimum(most, np.minimum(na[:, None], nb[None, :]))
        may = most >= needed(na[:, None], nb[None, :])
        if x is y:
            may &= np.tri(len(a), len(b), -1, bool)
        for side in self.unlike:
            may &= side[a][:, None] != side[b][None, :]
        root, join, link, places = self.groups.root, self.groups.join, self.link, self.places
        for p, q in zip(*np.nonzero(may), strict=True):
            i, j = places[a[p]], places[b[q]]
            if root(i) != root(j) and (link is None or link(i, j)):
                join(i, j)


def grouped(sizes: np.ndarray, maps: list[bytes], link: Callable[[int, int], bool] | None = None, side: np.ndarray | None = None) -> Groups:
    """Groups of sets by links, or by what their bitmaps allow. side: 0 or 1, only unlike sides are compared (None: all).

    Sets that can be linked have bitmaps of the same width or of one and its double: a tree for each width, and one for the
    neighbouring sizes of each two, with the wider bitmaps folded.
    """
    groups = Groups(len(sizes))
    by: dict[int, list[int]] = {}
    for i, m in enumerate(maps):
        by.setdefault(len(m), []).append(i)
    plain = [] if side is None else [side]

    def tree(at: np.ndarray, bits: np.ndarray, unlike) -> None:
        if len(at) > 1:
            SignatureTree(sizes[at], bits, at, groups, link, [u[at] for u in unlike]).run()

    wide = np.array([len(m) for m in maps])
    bits = {w: np.frombuffer(b"".join([maps[i] for i in at]), np.uint8).reshape(-1, w) for w, at in by.items()}
    for w in by:
        at = np.array(by[w])
        tree(at, bits[w], plain)
        if 2 * w in by:
            over = np.array(by[2 * w])
            a, b = 5 * sizes[at] >= 4 * sizes[over].min(), 4 * sizes[over] <= 5 * sizes[at].max()
            if a.any() and b.any():
                tree(np.concatenate([at[a], over[b]]), np.concatenate([bits[w][a], fold(bits[2 * w][b], w)]), [*plain, wide])
    return groups


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows that agree in the first columns, as column lists, from batches sorted by them."""
    held: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns]
        change = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held is not None and a == 0 and all(held[k][0] == columns[k][0] for k in range(keys)):
                for h, c in zip(held, columns, strict=True):
                    h += c[a:b]
                continue
            if held is not None:
                yield held
            held = [c[a:b] for c in columns]
    if held is not None:
        yield held


def common_shingles(texts: DataFrame, share: float = COMMON_SHARE, most: int = MOST_COMMON) -> np.ndarray:
    """Shingles that more than share of the documents of a task have, over all tasks: counted over all documents, used only to order.

    A task reports at most mean set size / share of them, so what reaches the driver is bounded by most after one grouped sum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, counts, held, size = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def fold_in():
            nonlocal keys, counts, held, size
            k, c = np.unique(np.concatenate(held), return_counts=True)
            k, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            c = np.bincount(at, np.concatenate([counts, c]), len(k)).astype(np.int64)
            # What is rare so far is let go once there is too much of it.
            keep = c >= max(1, int(share * docs / 2)) if len(k) > 2_000_000 else slice(None)
            keys, counts, held, size = k[keep], c[keep], [], 0

        for batch in batches:
            for t in batch.column(batch.num_columns - 1):
                docs += 1
                held.append(shingle_set(t.as_py(), WORDS))
                size += len(held[-1])
                if size > 1_000_000:
                    fold_in()
        if held:
            fold_in()
        top = counts > max(8, share * docs)
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["key", "n"])

    found = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most)
    return np.sort(np.array([r.key for r in found.select("key").collect()], np.int64).view(np.uint64))


SETS = "doc_id long, n long, s1 long, s2 long, prefix array<long>, map binary"


def sets_of(texts: DataFrame, common) -> DataFrame:
    """Per document: the size of its set, the set's 128-bit digest, its prefix and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            n, s, prefix, maps = [], [], [], []
            for t in batch.column(1):
                x = shingle_set(t.as_py(), WORDS)
                n.append(len(x))
                s.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                if len(last) and len(x):
                    at = np.searchsorted(last, x)
                    hot = last[np.minimum(at, len(last) - 1)] == x
                    ordered = np.concatenate([x[~hot], x[hot]])
                else:
                    ordered = x
                prefix.append(ordered[: prefix_length(len(x)) if len(x) else 0].view(np.int64))
                maps.append(bitmap(x, bitmap_bits(len(x))))
            d = np.frombuffer(b"".join(s), np.int64).reshape(-1, 2)
            offsets = np.cumsum([0] + [len(p) for p in prefix])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(maps, pa.binary())], ["doc_id", "n", "s1", "s2", "prefix", "map"])

    return texts.mapInArrow(run, SETS)


def in_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows of a key as (i, j) of blocks that meet, and own (0 or 1) where two blocks do; keys of up to block rows are one block with themselves."""
    b = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block))).cast("int")
    mine = rows.withColumn("_b", b).withColumn("_k", F.pmod(F.xxhash64("cid"), F.col("_b")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return mine.withColumn("i", F.least("_k", "_o")).withColumn("j", F.greatest("_k", "_o")).withColumn("own", (F.col("_k") == F.col("i")).cast("int")).drop("_b", "_k", "_o")


def counted_pairs(shared: DataFrame, paired: int) -> DataFrame:
    """Pairs (a, b) of classes that share small keys, if they share enough of them.

    Of two prefixes take the one that ends first: what it doesn't share with the other isn't in the other's set at all. So
    a link needs at least needed - n + prefix_length common keys, with n of that class; keys that aren't counted here may all be common.
    """
    small = shared.where(F.col("count") <= paired).select("key", "cid", "n")
    large = shared.where(F.col("count") > paired).groupBy("cid").agg(F.count("*").alias("more"))
    a, b = (small.select("key", F.col("cid").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, "key").where("a < b and 5 * na >= 4 * nb and 5 * nb >= 4 * na").groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"))
    more = F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    need = F.ceil(4 * (F.col("na") + F.col("nb")) / 9)
    least = lambda n: need - F.col(n) + F.col(n) - F.ceil(4 * F.col(n) / 5) + 1
    enough = F.col("c") + more >= F.least(least("na"), least("nb"))
    # Without the larger keys the count may fall short of what they could add, so they are looked up for the rest.
    met = met.join(large.select(F.col("cid").alias("a"), F.col("more").alias("ma")), "a", "left").join(large.select(F.col("cid").alias("b"), F.col("more").alias("mb")), "b", "left")
    return met.where(enough).select("a", "b")


def treed_pairs(shared: DataFrame, classes: DataFrame, paired: int, block: int) -> DataFrame:
    """Edges (a, b) between classes that share a large key and whose bitmaps allow a link: for each key one fewer than the members of each group they form."""
    large = shared.where(F.col("count") > paired)
    rows = in_blocks(large, "key", "count", block).join(classes.select("cid", "map"), "cid").select("key", "i", "j", "own", "cid", "n", "map")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, i, j, own, cid, n, maps in runs(batches, 3):
            groups = grouped(np.array(n, np.int64), maps, None, np.array(own) if i[0] != j[0] else None)
            for p in range(len(cid)):
                if (r := groups.root(p)) != p:
                    a.append(cid[p])
                    b.append(cid[r])
            if len(a) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def may_be_linked(classes: DataFrame, block: int, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between classes that may be linked: every link is an edge, or follows from edges."""
    keys = classes.where("n > 0").select("cid", "n", F.explode("prefix").alias("key"))
    # Counted map-side first and joined back, so that a key of any size is no task's own.
    counts = keys.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    shared = written(keys.join(counts, "key"), "shared")
    edges = written(counted_pairs(shared, paired).unionByName(treed_pairs(shared, classes, paired, block)).distinct(), "edges")
    forget(shared)
    return edges


#: Bits of the filter on documents whose whole sets are needed: 8 MB, whatever the input; where it fills up it only lets more through.
FILTER_BITS = 1 << 26


def _filter(ids: DataFrame) -> bytes:
    """A bit for the hash of each id, gathered by stretches of 2 ** 16 bits."""
    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")).distinct().withColumn("stretch", F.expr("bit div 65536"))

    def run(key, t):
        bits = np.zeros(65536, np.uint8)
        bits[t.column("bit").to_numpy() % 65536] = 1
        return pa.table({"stretch": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = bytearray(FILTER_BITS // 8)
    for r in at.groupBy("stretch").applyInArrow(run, "stretch long, bits binary").collect():
        out[r.stretch * 8192 : (r.stretch + 1) * 8192] = r.bits
    return bytes(out)


def whole_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s1, s2, n, set) of the documents whose ids are wanted, and of some more."""
    bits = texts.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = np.flatnonzero(have[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            sets = [shingle_set(batch.column(1)[int(k)].as_py(), WORDS).tobytes() for k in keep]
            d = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sets, pa.binary())], ["s1", "s2", "set"])

    rows = texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    return rows.mapInArrow(run, "s1 long, s2 long, set binary")


def links_within(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is linked, from rows (grp, i, j, own, cid, set) of whole sets, exactly."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("grp", "i", "j", "own", "cid", "set").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, cid, sets in runs(batches, 3):
            if len(cid) < 2:
                continue
            x = [np.frombuffer(s, np.uint64) for s in sets]
            sizes = np.array([len(s) for s in x], np.int64)

            def link(p: int, q: int, x=x, sizes=sizes) -> bool:
                s, t = (x[p], x[q]) if sizes[p] <= sizes[q] else (x[q], x[p])
                overlap = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                return overlap >= needed(int(sizes[p]), int(sizes[q]))

            groups = grouped(sizes, [bitmap(s, bitmap_bits(len(s))) for s in x], link, np.array(own) if i[0] != j[0] else None)
            at = [(cid[p], cid[r]) for p in range(len(cid)) if (r := groups.root(p)) != p]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in at], pa.int64()), pa.array([q for _, q in at], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def joined(docs: DataFrame, block: int = BLOCK, share: float = COMMON_SHARE, paired: int = PAIRED) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every row of (doc_id, text); other columns are dropped.

    Null and empty texts and those without words have an empty set and link with nothing. Rows with equal sets are in one component,
    whatever their doc_id; a null doc_id is never the smallest, and a component of null ids alone is null.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(texts, share))
    sets = written(sets_of(texts, common), "sets")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("map").alias("map"))
    full = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    ids = written(sets.select("doc_id", "n", "s1", "s2"), "ids")
    forget(sets)
    edges = may_be_linked(full, block, paired)
    classes = written(full.select("s1", "s2", "cid", "low"), "classes")
    forget(full)
    near = components(edges).withColumnsRenamed({"node": "cid", "component": "grp"})
    near = near.unionByName(near.select(F.col("grp").alias("cid"), "grp")).distinct()
    near = written(near.join(classes, "cid"), "near")
    forget(edges)
    found = whole_sets(texts, near.select(F.col("low").alias("doc_id")))
    sized = near.join(near.groupBy("grp").agg(F.count("*").alias("count")), "grp")
    # Copies that got through with their class's id are dropped after the join, on its partitioning.
    held = found.join(sized, ["s1", "s2"]).dropDuplicates(["s1", "s2"])
    linked = components(links_within(in_blocks(held, "grp", "count", block))).withColumnsRenamed({"node": "cid", "component": "root"})
    # The smallest doc_id of each component, from its classes' smallest.
    of = classes.join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(least, "root").select("s1", "s2", "component_id")
    some = ids.where("n > 0").join(of, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def op10_jaccard_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_signature_trees": op10_jaccard_signature_trees}
