"""Boxes on pages: claims of words by runs, explained differences, greedy correlation, merging, reading order, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1.5


def overlap_area(a: str, b: str) -> Column:
    """Of columns a_x, a_y, a_w, a_h and those of b."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{p}") + F.col(f"{a}_{s}"), F.col(f"{b}_{p}") + F.col(f"{b}_{s}")) - F.greatest(F.col(f"{a}_{p}"), F.col(f"{b}_{p}")))
    return side("x", "w") * side("y", "h")


def claimed_words(words: DataFrame, runs: DataFrame, cell: float = 100.0) -> DataFrame:
    """Each word (page, word, w_x, w_y, w_w, w_h) with the run whose padded box holds its centre: the smallest, then the first. Unclaimed words are left out.

    Runs are spread over a grid of cells on the page, so the join has equal keys and stays in proportion.
    """
    pad = F.greatest(F.lit(SLACK), 0.3 * F.col("r_h"))
    spread = runs.withColumn("pad", pad)
    for axis, size in (("x", "w"), ("y", "h")):
        low, high = F.floor((F.col(f"r_{axis}") - F.col("pad")) / cell), F.floor((F.col(f"r_{axis}") + F.col(f"r_{size}") + F.col("pad")) / cell)
        spread = spread.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    at = words.withColumn("mx", F.col("w_x") + F.col("w_w") / 2).withColumn("my", F.col("w_y") + F.col("w_h") / 2)
    at = at.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell))
    held = F.col("mx").between(F.col("r_x") - F.col("pad"), F.col("r_x") + F.col("r_w") + F.col("pad")) & F.col("my").between(F.col("r_y") - F.col("pad"), F.col("r_y") + F.col("r_h") + F.col("pad"))
    first = F.min(F.struct((F.col("r_w") * F.col("r_h")).alias("area"), "run")).alias("best")
    return at.join(spread, ["page", "cx", "cy"]).where(held).groupBy("page", "word").agg(first).select("page", "word", "best.run")


def first_claims(changes: DataFrame, differences: DataFrame) -> DataFrame:
    """Greedy one-shot claims: a difference belongs to the first change (phase, ord) of its page that it overlaps within the slack."""
    c = changes.select("page", "phase", "ord", "c_x", "c_y", "c_w", "c_h")
    near = (F.col("d_x") <= F.col("c_x") + F.col("c_w") + SLACK) & (F.col("c_x") <= F.col("d_x") + F.col("d_w") + SLACK) & (F.col("d_y") <= F.col("c_y") + F.col("c_h") + SLACK) & (F.col("c_y") <= F.col("d_y") + F.col("d_h") + SLACK)
    return differences.join(c, "page").where(near).groupBy("page", "diff").agg(F.min(F.struct("phase", "ord")).alias("first")).select("page", "diff", "first.phase", "first.ord")


def explained(differences: DataFrame, regions: DataFrame) -> DataFrame:
    """The first region (by order) that half of an added text, or any part of another difference if the region is identified, lies in."""
    o = overlap_area("d", "r")
    hit = F.when(F.col("kind") == "added", o >= 0.5 * F.col("d_w") * F.col("d_h")).otherwise(F.col("identified") & (o > 0))
    return differences.join(regions, "page").where(hit).groupBy("page", "diff").agg(F.min("region").alias("region"))


def top_per_page(changes: DataFrame, limit: int = 50) -> DataFrame:
    """The largest changes of each page, ties by order, with truncated: whether the page had more."""
    w = Window.partitionBy("page")
    return changes.withColumn("rank", F.row_number().over(w.orderBy(F.desc("pixels"), "ord"))).withColumn("truncated", F.count("*").over(w) > limit).where(F.col("rank") <= limit)


def spread_top(points: DataFrame, budget: int, grid: int = 8) -> DataFrame:
    """Spatially even top list of (page, point, cell, score): the best of each cell up to an even share, then the best left over."""
    share = budget // (grid * grid)
    per_cell = Window.partitionBy("page", "cell").orderBy(F.desc("score"), "point")
    ranked = points.withColumn("first", (F.row_number().over(per_cell) <= share).cast("int"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("first"), F.desc("score"), "point"))).where(F.col("rank") <= budget)


def islands(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions: first, last and length of each."""
    w = Window.partitionBy(*by).orderBy(position)
    return rows.select(*by, position).distinct().withColumn("_g", F.col(position) - F.row_number().over(w)).groupBy(*by, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length")).drop("_g")


#: Rows that a task folds at a time, on average: pages are gathered, as a task for each page would cost more than its work.
FOLDED_ROWS = 20_000


def by_pages(rows: DataFrame, columns: list[str], fold, schema: str) -> DataFrame:
    """fold(page, its rows as tuples of the other columns) for each page, by groups of whole pages. A page's rows are bounded by its area."""
    groups = max(1, -(-rows.count() // FOLDED_ROWS))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["page", columns[0]], kind="stable")
        pages, others = pdf["page"].tolist(), list(zip(*(pdf[c].tolist() for c in columns), strict=True))
        out, start = [], 0
        for k in range(1, len(pages) + 1):
            if k == len(pages) or pages[k] != pages[start]:
                out += fold(pages[start], others[start:k])
                start = k
        return pd.DataFrame(out, columns=names)

    return rows.select("page", *columns).withColumn("_g", F.pmod(F.xxhash64("page"), F.lit(groups))).groupBy("_g").applyInPandas(run, schema)


def reading_order(words: DataFrame) -> DataFrame:
    """Rows of a page by the centre of the first word of each row (within half the smaller height), then from left to right: adds row and place."""

    def fold(page, rows):
        at, first, placed = -1, None, []
        for word, x, y, h in sorted(rows, key=lambda r: (r[2] + r[3] / 2, r[1], r[0])):
            centre = y + h / 2
            if first is None or centre - first[0] > 0.5 * min(h, first[1]):
                at, first = at + 1, (centre, h)
            placed.append((at, x, word))
        return [(page, word, row, k) for k, (row, _, word) in enumerate(sorted(placed))]

    return by_pages(words, ["word", "x", "y", "h"], fold, "page long, word long, row long, place long")


def merged(boxes: DataFrame, gap: float) -> DataFrame:
    """Boxes (page, box, x, y, w, h, pixels) joined with all within gap, until none is: one row per cluster."""

    def fold(page, rows):
        left = [[x, y, x + w, y + h, pixels, 1] for _, x, y, w, h, pixels in rows]
        done = False
        while not done:
            done, out = True, []
            for b in left:
                for o in out:
                    if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]), o[4] + b[4], o[5] + b[5]]
                        done = False
                        break
                else:
                    out.append(b)
            left = out
        return [(page, b[0], b[1], b[2] - b[0], b[3] - b[1], b[4], b[5]) for b in left]

    return by_pages(boxes, ["box", "x", "y", "w", "h", "pixels"], fold, "page long, x double, y double, w double, h double, pixels long, parts long")
