"""Lets Python workers import this package, wherever they run."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever they run: Spark's file server hands out a zip of it, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "folioscope_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "folioscope")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def keep_freed() -> None:
    """Let this worker's heap keep up to 64 MB that it freed, where there is glibc: images of a few MB, made again and again, don't have to be mapped and cleared each time."""
    try:
        heap = ctypes.CDLL(None)
        heap.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        heap.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):
        return
