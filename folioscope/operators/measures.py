"""Grouped measures: document scores, pairs of pages, thresholds and trims from histograms. Histograms have a bounded number of bins, so their windows are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_score(pages: DataFrame, by: list[str], empty: float | None = None) -> DataFrame:
    """(by, score, pages): page scores weighted by characters; where a document has none, their plain mean, or `empty`."""
    g = pages.groupBy(*by).agg(F.sum("characters").alias("_c"), F.avg("score").alias("_m"), F.sum(F.col("score") * F.col("characters")).alias("_w"), F.count("*").alias("pages"))
    return g.select(*by, F.when(F.col("_c") > 0, F.col("_w") / F.col("_c")).otherwise(F.col("_m") if empty is None else F.lit(empty)).alias("score"), "pages")


def paired(issued: DataFrame, returned: DataFrame, doc: list[str], pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of pages, pages left over): page k of one side with page k of the other, or as pairs (doc, issued, returned) say.

    issued and returned: doc, page. Pairs that name a page that isn't there, or one page twice, come back as left over with a problem.
    """
    a, b = issued.select(*doc, F.col("page").alias("issued")).distinct(), returned.select(*doc, F.col("page").alias("returned")).distinct()
    if pairs is None:
        met = a.withColumn("page", F.col("issued")).join(b.withColumn("page", F.col("returned")), [*doc, "page"]).select(*doc, "issued", "returned")
        problems = None
    else:
        w = lambda side: Window.partitionBy(*doc, side).orderBy("issued", "returned")
        asked = pairs.select(*doc, "issued", "returned").join(a.withColumn("_a", F.lit(True)), [*doc, "issued"], "left").join(b.withColumn("_b", F.lit(True)), [*doc, "returned"], "left")
        asked = asked.withColumn("_i", F.row_number().over(w("issued"))).withColumn("_r", F.row_number().over(w("returned")))
        problem = F.when(F.col("_a").isNull(), "no such issued page").when(F.col("_b").isNull(), "no such returned page").when((F.col("_i") > 1) | (F.col("_r") > 1), "paired twice")
        asked = asked.withColumn("problem", problem)
        met = asked.where("problem is null").select(*doc, "issued", "returned")
        problems = asked.where("problem is not null").select(*doc, F.lit("pair").alias("side"), F.coalesce("issued", "returned").alias("page"), "problem")
    left = lambda side, name: side.join(met, [*doc, name], "left_anti").select(*doc, F.lit(name).alias("side"), F.col(name).alias("page"), F.lit(None).cast("string").alias("problem"))
    over = left(a, "issued").unionByName(left(b, "returned"))
    return met, over if problems is None else over.unionByName(problems)


def histogram(values: DataFrame, by: list[str], bin_of: Column) -> DataFrame:
    """(by, bin, n)."""
    return values.groupBy(*by, bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu(bins: DataFrame, by: list[str]) -> DataFrame:
    """The bin up to which the darker class goes: the largest variance between classes, the first of equal ones."""
    w, a = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    c = bins.select(*by, "bin", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(a).alias("n1"), F.sum(F.col("n") * F.col("bin")).over(a).alias("s1")).where("n1 > n0")
    var = F.col("n0").cast("double") * (F.col("n1") - F.col("n0")) * F.pow(F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0")), 2)
    return c.groupBy(*by).agg(F.min(F.struct((-F.round(var, 3)).alias("v"), "bin")).alias("best")).select(*by, "best.bin")


def cumulated(bins: DataFrame, by: list[str]) -> DataFrame:
    """Bins with upto, the sum up to each, and total."""
    return bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def first_bin(share: float) -> Column:
    """Over cumulated(): the first bin at which the share is reached."""
    return F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("bin")))


def contrast_points(bins: DataFrame, by: list[str], scale: float = 1.5 / 255) -> DataFrame:
    """Black and white points of paper ratios in bins of scale: 1 % and 99 %, within 0 to 0.4 and 0.7 to 1.1."""
    within = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c * scale))
    return cumulated(bins, by).groupBy(*by).agg(within(first_bin(0.01), 0.0, 0.4).alias("black"), within(first_bin(0.99), 0.7, 1.1).alias("white"))


def trims(bins: DataFrame, by: list[str], share: float = 0.004) -> DataFrame:
    """The first and last bin that are left when a share is cut off at each end."""
    over = F.min(F.when(F.col("upto") > F.col("total") * share, F.col("bin")))
    return cumulated(bins, by).groupBy(*by).agg(over.alias("first"), first_bin(1 - share).alias("last"))
