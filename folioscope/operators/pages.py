"""Pages as rows: samples, positions, batches, choice of a preparation, display coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages that a preparation is tried on, and pages of a batch.
SAMPLE, BATCH = 3, 4


def _place(pages: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return pages.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))


def sample_spread(pages: DataFrame, by: list[str], order: str, count: int = SAMPLE) -> DataFrame:
    """count pages of each document, evenly spread from the first to the last (halves go up); all of a shorter one."""
    step = (F.col("_n") - 1) / F.lit(float(count - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * step + 0.5))
    return _place(pages, by, order).where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def positions(pages: DataFrame, by: list[str], order: str) -> DataFrame:
    """Pages with index (from 1) and total of their document, as progress is told."""
    return _place(pages, by, order).withColumn("index", F.col("_i") + 1).withColumn("total", F.col("_n")).drop("_i", "_n")


def batches(pages: DataFrame, by: list[str], order: str, size: int = BATCH) -> DataFrame:
    """Pages with batch (from 1) and the number of batches of their document; batches are work that can be done apart."""
    if size < 1:
        raise ValueError("a batch has one page at least")
    return _place(pages, by, order).withColumn("batch", F.floor(F.col("_i") / size) + 1).withColumn("batches", F.ceil(F.col("_n") / size)).drop("_i", "_n")


def best_recipe(tried: DataFrame, by: list[str]) -> DataFrame:
    """The recipe of each document with the best score, weighted by the characters of the pages it was tried on (the plain mean if there are none); of equal ones the first.

    tried: by, recipe, ord (order of recipes), score and characters of a page.
    """
    g = tried.groupBy(*by, "recipe", "ord").agg(F.sum("characters").alias("c"), F.avg("score").alias("m"), F.sum(F.col("score") * F.col("characters")).alias("w"))
    g = g.withColumn("score", F.when(F.col("c") > 0, F.col("w") / F.col("c")).otherwise(F.col("m")))
    return g.groupBy(*by).agg(F.max(F.struct("score", (-F.col("ord")).alias("first"), "recipe")).alias("best")).select(*by, "best.recipe", "best.score")


def viewport(x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column) -> Column:
    """The matrix (a, b, c, d, e, f) from user space to display points, for a crop box and a rotation by a multiple of 90 degrees; another one is an error."""
    turn = F.pmod(rotation.cast("int"), F.lit(360))
    pick = lambda *v: F.when(turn == 0, v[0]).when(turn == 90, v[1]).when(turn == 180, v[2]).when(turn == 270, v[3]).otherwise(F.raise_error(F.concat(F.lit("not a quarter turn: "), rotation.cast("string"))).cast("double"))
    a, b, c, d = pick(1.0, 0.0, -1.0, 0.0), pick(0.0, 1.0, 0.0, -1.0), pick(0.0, 1.0, 0.0, -1.0), pick(-1.0, 0.0, 1.0, 0.0)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    quarter = turn.isin(90, 270)
    across, down = F.abs(cx - x0), F.abs(cy - y0)
    e, f = F.when(quarter, down).otherwise(across) - a * cx - c * cy, F.when(quarter, across).otherwise(down) - b * cx - d * cy
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"))


def viewport_size(x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column) -> Column:
    """Width and height as displayed."""
    quarter = F.pmod(rotation.cast("int"), F.lit(360)).isin(90, 270)
    return F.struct(F.when(quarter, y1 - y0).otherwise(x1 - x0).alias("width"), F.when(quarter, x1 - x0).otherwise(y1 - y0).alias("height"))


def to_display(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def to_user_space(m: Column, x: Column, y: Column) -> Column:
    """A display point in user space."""
    det, dx, dy = m["a"] * m["d"] - m["b"] * m["c"], x - m["e"], y - m["f"]
    return F.struct(((m["d"] * dx - m["c"] * dy) / det + 0.0).alias("x"), ((m["a"] * dy - m["b"] * dx) / det + 0.0).alias("y"))
