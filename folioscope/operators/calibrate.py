"""Threshold calibration over labelled documents: a grid of limits, false accepts and reviews, and their confidence bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964
# The limits that are tried.
TEXT, CHANGE, MISSING = (0.75, 0.8, 0.85, 0.9, 0.95), (1.0, 2.0, 4.0, 8.0), (4.0, 8.0, 16.0)


def wilson_upper(hits: Column, trials: Column, z: float = Z) -> Column:
    """Upper bound of the Wilson interval, at most 1; null without trials."""
    p, n = hits / trials, trials.cast("double")
    return F.when(trials > 0, F.least(F.lit(1.0), (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)))


def grid(spark, text=TEXT, change=CHANGE, missing=MISSING) -> DataFrame:
    return spark.createDataFrame([(i, t, c, m) for i, (t, c, m) in enumerate((t, c, m) for t in text for c in change for m in missing)], "point int, min_text double, min_change double, min_missing double")


def corpus_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """What a sweep needs of audited documents, one row for each: sample, text_score, worst_change, worst_missing, always.

    pages: sample, page, text_score. found: sample, kind, ink_mm2 (null: a finding of text alone) and has_text; findings with text, or without ink, count at
    any limit. Documents may arrive as a stream of cases: both sides are grouped by sample, so cases of later files only add rows.
    """
    counts_always = F.col("ink_mm2").isNull() | F.col("has_text")
    ink = lambda missing: F.max(F.when(~counts_always & ((F.col("kind") == "missing-ink") == F.lit(missing)), F.col("ink_mm2")))
    worst = found.groupBy("sample").agg(ink(False).alias("worst_change"), ink(True).alias("worst_missing"), F.bool_or(counts_always).alias("always"))
    least = pages.groupBy("sample").agg(F.min("text_score").alias("text_score"))
    return least.join(worst, "sample", "full").withColumn("always", F.coalesce("always", F.lit(False)))


def reachable(points: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points at which all samples can be judged, and those below the limit that some sample's findings were gathered with (floor_change, floor_missing; null: none)."""
    floor = samples.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("floor_change"), F.lit(0.0))).alias("_c"), F.greatest(F.lit(0.0), F.coalesce(F.max("floor_missing"), F.lit(0.0))).alias("_m"))
    met = points.join(F.broadcast(floor))  # one row
    can = (F.col("min_change") >= F.col("_c")) & (F.col("min_missing") >= F.col("_m"))
    return met.where(can).drop("_c", "_m"), met.where(~can).drop("_c", "_m")


def reviewed(pages: DataFrame, samples: DataFrame, points: DataFrame) -> DataFrame:
    """Whether each sample goes to review at each point: point, limits, sample, genuine, review. A document without pages passes."""
    worst = pages.groupBy("sample").agg(F.min("text_score").alias("text_score"), F.max("worst_change").alias("change"), F.max("worst_missing").alias("missing"), F.bool_or("always").alias("always"))
    tried = samples.select("sample", "genuine").join(worst, "sample", "left").join(F.broadcast(points))  # the grid is a constant of a few dozen rows
    review = F.coalesce(F.col("text_score") < F.col("min_text"), F.lit(False)) | F.coalesce(F.col("change") >= F.col("min_change"), F.lit(False)) | F.coalesce(F.col("missing") >= F.col("min_missing"), F.lit(False)) | F.coalesce("always", F.lit(False))
    return tried.select("point", "min_text", "min_change", "min_missing", "sample", "genuine", review.alias("review"))


def failing(pages: DataFrame, samples: DataFrame, points: DataFrame) -> DataFrame:
    """(point, sample, failure) of altered samples that pass and genuine ones that don't."""
    r = reviewed(pages, samples, points).where(F.col("genuine") == F.col("review"))
    return r.select("point", "sample", F.when(F.col("genuine"), "false-review").otherwise("false-accept").alias("failure"))


def sweep(pages: DataFrame, samples: DataFrame, points: DataFrame) -> DataFrame:
    """Rates of each grid point.

    pages: sample, text_score, worst_change and worst_missing (largest ink areas of findings without text; null: none) and always (a
    finding that counts at any limit). samples: sample and genuine. A document passes if all its pages do. Pages are reduced to the
    worst of each document before they meet the grid, so the product is documents by points.
    """
    review = F.col("review")
    g = reviewed(pages, samples, points).groupBy("point", "min_text", "min_change", "min_missing").agg(
        F.count_if(F.col("genuine")).alias("genuine"),
        F.count_if(~F.col("genuine")).alias("altered"),
        F.count_if(~F.col("genuine") & ~review).alias("false_accepts"),
        F.count_if(F.col("genuine") & review).alias("false_reviews"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return (
        g.withColumn("accept_rate", rate("false_accepts", "altered"))
        .withColumn("review_rate", rate("false_reviews", "genuine"))
        .withColumn("accept_upper", wilson_upper(F.col("false_accepts"), F.col("altered")))
        .withColumn("review_upper", wilson_upper(F.col("false_reviews"), F.col("genuine")))
    )


def ranked(swept: DataFrame) -> DataFrame:
    """Adds rank (fewest accepts, then reviews, then grid order) and best: the first, if it accepts nothing and something altered was sampled."""
    order = Window.orderBy("false_accepts", "false_reviews", "point")
    return swept.withColumn("rank", F.row_number().over(order)).withColumn("best", (F.col("rank") == 1) & (F.col("false_accepts") == 0) & (F.col("altered") > 0))
