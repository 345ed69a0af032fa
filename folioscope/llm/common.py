"""What several operators share: tables, the shared folder, written cuts of the lineage, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioscope.workers import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a local session (as in tests) gets a folder of our own; on a cluster no folder of the driver's would do, so RuntimeError is raised.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folioscope-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a lost executor costs no recomputation, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_added(docs: DataFrame, column: str, new: list[StructField], compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with new columns that compute gives for a batch of one text column (null counts as empty).

    Columns of docs that are named like a new one, whatever their case, are replaced; all others may have any name, as they pass by position.
    """
    taken = {f.name.lower() for f in new}
    keep = [k for k, n in enumerate(docs.columns) if n.lower() not in taken]
    names = [docs.columns[k] for k in keep] + [f.name for f in new]
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    passed = plain.select(text_or_empty(f"c{docs.columns.index(column)}").alias("t"), *(f"c{k}" for k in keep))
    fields = [StructField(f"c{k}", docs.schema[k].dataType) for k in keep] + [StructField(f"n{k}", f.dataType) for k, f in enumerate(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("texts",), bool)  # lets go of what another operator kept in this worker
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *compute(batch.column(0))], [f.name for f in fields])

    return passed.mapInArrow(run, StructType(fields)).toDF(*names)


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more, and let go of shuffle files, plans and compiled code that nothing refers to."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()
        jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of edges (a, b): returns (node, component), the smallest node reachable, for every node that has an edge to another.

    Alternates large-star and small-star steps until nothing changes; each step is one grouped minimum and one join, both on the node,
    so a star of any size is pre-aggregated and AQE may split its join. Each round is written to the shared folder.
    Nulls and loops are dropped; repeated edges are harmless; no edges give no rows. Raises RuntimeError if most rounds aren't enough.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc")
    last, rounds = None, []
    for _ in range(most):
        # Large star: every neighbour above the node hangs on the smallest of the node and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The smallest neighbour's own edge is kept: the node itself hangs on it, if it is lower.
        large = large.where("u != v").distinct()
        # Small star: the node and its neighbours below it hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        rounds.append(e)
        e = written(small, "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            forget(*rounds)
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = state
    raise RuntimeError(f"no fixed point after {most} rounds")


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """make(), kept by this worker process until another operator asks for something else: a worker that is used again holds one model or vocabulary at a time."""
    if key not in _kept:
        _kept.clear()
        trim()
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Give freed memory back: Arrow's pool and, where there is glibc, the heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
