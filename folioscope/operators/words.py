"""Words that were read against runs that were printed: who owns a word, what a run reads, and what differs.

Runs: by, run (order), text, ends_line and box r. Words: by, word (order), line, text, confidence and box w. Boxes are in points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Least confidence and height of added writing, similarity from which a run agrees, glyphs kept of a kind.
CONFIDENCE, HEIGHT, MATCH, KEPT_GLYPHS = 60.0, 4.0, 0.8, 4
#: Points of a side of the grid cells in which words and runs meet.
CELL = 100.0
FIGURE = r"^[\d\s.,:/%()+-]+$"


def is_writing(text: Column, confidence: Column, height: Column, least: float = CONFIDENCE) -> Column:
    """Whether an unclaimed word is writing rather than noise."""
    return (F.coalesce(confidence, F.lit(0.0)) >= least) & (height >= HEIGHT) & (T.normalise(text) != "")


def claimed(words: DataFrame, runs: DataFrame, by: list[str], cell: float = CELL) -> DataFrame:
    """words with run: the run whose padded box holds the word's centre, the smallest, then the first; null if none does."""
    pad = F.greatest(F.lit(1.5), 0.3 * F.col("r_h"))
    spread = runs.select(*by, "run", "r_x", "r_y", "r_w", "r_h", pad.alias("_pad"))
    for axis, size in (("x", "w"), ("y", "h")):
        low, high = F.floor((F.col(f"r_{axis}") - F.col("_pad")) / cell), F.floor((F.col(f"r_{axis}") + F.col(f"r_{size}") + F.col("_pad")) / cell)
        spread = spread.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    at = words.withColumn("_mx", F.col("w_x") + F.col("w_w") / 2).withColumn("_my", F.col("w_y") + F.col("w_h") / 2)
    at = at.withColumn("_cx", F.floor(F.col("_mx") / cell)).withColumn("_cy", F.floor(F.col("_my") / cell))
    held = F.col("_mx").between(F.col("r_x") - F.col("_pad"), F.col("r_x") + F.col("r_w") + F.col("_pad")) & F.col("_my").between(F.col("r_y") - F.col("_pad"), F.col("r_y") + F.col("r_h") + F.col("_pad"))
    best = at.join(spread, [*by, "_cx", "_cy"]).where(held).groupBy(*by, "word").agg(F.min(F.struct((F.col("r_w") * F.col("r_h")).alias("a"), "run"))["run"].alias("run"))
    return words.join(best, [*by, "word"], "left")


def readings(owned: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, found): the words of each run in reading order, by rows, then from left to right.

    A row starts where a word's centre is more than half the smaller height below the centre of the row's first word.
    """
    w = F.struct((F.col("w_y") + F.col("w_h") / 2).alias("c"), "word", F.col("w_x").alias("x"), F.col("w_h").alias("h"), "text")
    listed = owned.where("run is not null").groupBy(*by, "run").agg(F.array_sort(F.collect_list(w)).alias("ws"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).cast("double").alias("c"), F.lit(0.0).cast("double").alias("h"), F.array().cast("array<struct<row:int,x:double,word:bigint,text:string>>").alias("out"))

    def step(s, x):
        new = (s["row"] < 0) | (x["c"] - s["c"] > F.least(s["h"], x["h"]) / 2)
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        put = F.struct(row.alias("row"), x["x"].cast("double").alias("x"), x["word"].cast("long").alias("word"), x["text"].alias("text"))
        return F.struct(row.alias("row"), F.when(new, x["c"]).otherwise(s["c"]).alias("c"), F.when(new, x["h"]).otherwise(s["h"]).alias("h"), F.concat(s["out"], F.array(put)).alias("out"))

    rows = F.aggregate("ws", start, step)["out"]
    return listed.select(*by, "run", F.array_join(F.transform(F.array_sort(rows), lambda x: x["text"]), " ").alias("found"))


def judged(expected: Column, found: Column, least: float = MATCH) -> Column:
    """What a run's reading is worth: struct(kind, reason, similarity); kind is null where it agrees. Digits come before similarity."""
    want, read = T.normalise(expected), T.normalise(F.coalesce(found, F.lit("")))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    similar = T.levenshtein_similarity(want, read)
    put = lambda kind, reason, s: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(reason).cast("string").alias("reason"), s.alias("similarity"))
    return (
        F.when(want == "", put(None, None, F.lit(1.0)))
        .when(read == "", put("missing", "text", F.lit(0.0)))
        .when(digits(want) != digits(read), put("changed", "numbers", similar))
        .when(want.rlike(FIGURE), put(None, None, similar))
        .when(similar < least, put("changed", "text", similar))
        .otherwise(put(None, None, similar))
    )


def matched(words: DataFrame, runs: DataFrame, by: list[str], least: float = MATCH) -> DataFrame:
    """Differences (by, ord, kind, expected, found, reason, similarity, x, y, w, h): runs that are missing or changed, in order, then added writing by line."""
    owned = claimed(words, runs, by)
    read = runs.join(readings(owned, by), [*by, "run"], "left").withColumn("v", judged(F.col("text"), F.col("found"), least)).where("v.kind is not null")
    changed = read.select(*by, F.col("run").cast("long").alias("_o"), F.lit(0).alias("_part"), F.col("v.kind").alias("kind"), F.col("text").alias("expected"), F.when(F.col("v.kind") != "missing", F.col("found")).alias("found"), F.col("v.reason").alias("reason"), F.col("v.similarity").alias("similarity"), *(F.col(f"r_{c}").alias(c) for c in "xywh"))
    new = owned.where("run is null").where(is_writing(F.col("text"), F.col("confidence"), F.col("w_h")))
    lines = new.groupBy(*by, "line").agg(
        F.min("word").cast("long").alias("_o"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("found"),
        F.min("w_x").alias("x"),
        F.min("w_y").alias("y"),
        (F.max(F.col("w_x") + F.col("w_w")) - F.min("w_x")).alias("w"),
        (F.max(F.col("w_y") + F.col("w_h")) - F.min("w_y")).alias("h"),
    )
    added = lines.select(*by, "_o", F.lit(1).alias("_part"), F.lit("added").alias("kind"), F.lit(None).cast("string").alias("expected"), "found", F.lit("text").alias("reason"), F.lit(0.0).alias("similarity"), "x", "y", "w", "h")
    order = Window.partitionBy(*by).orderBy("_part", "_o")
    return changed.unionByName(added).withColumn("ord", F.row_number().over(order)).drop("_part", "_o")


def template_key(font: Column, size: Column, angle: Column, character: Column) -> Column:
    """Glyphs of one font, half-point size, quarter turn and character look alike."""
    half = F.floor(size * 2 + 0.5) / 2
    turn = F.pmod(F.floor(angle / 90 + 0.5), F.lit(4)) * 90
    return F.concat_ws("|", font, half.cast("string"), turn.cast("int").cast("string"), character)


def templates(glyphs: DataFrame, key: str, order: list[str], kept: int = KEPT_GLYPHS) -> DataFrame:
    """The first glyphs of each kind."""
    return glyphs.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= kept).drop("_k")


def merged_reading(read: Column, printed: Column, cells: Column, verified: Column) -> Column:
    """A run's reading with the characters that its print decided: cells are struct(at, printed, read), at counting visible characters from 0.

    Nothing decided: the reading stays. Nothing read: the print's reading. Where the numbers of visible characters differ, the print's reading
    counts if it decided that a character changed, else the reading stays.
    """
    seen = lambda c: F.filter(F.split(c, ""), lambda x: F.trim(x) != "")
    decided = F.filter(cells, lambda c: c["read"].isNotNull())
    by_place = F.map_from_entries(F.transform(decided, lambda c: F.struct(c["at"], c["read"])))
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def put(s, c):
        visible = F.trim(c) != ""
        return F.struct(F.when(visible, s["k"] + 1).otherwise(s["k"]).alias("k"), F.concat(s["out"], F.when(visible, F.coalesce(F.try_element_at(by_place, s["k"]), c)).otherwise(c)).alias("out"))

    merged = F.aggregate(F.filter(F.split(read, ""), lambda x: x != ""), start, put)["out"]
    changed = F.exists(decided, lambda c: c["read"] != c["printed"])
    return F.when(F.size(decided) == 0, read).when(F.trim(read) == "", verified).when(F.size(seen(read)) != F.size(seen(printed)), F.when(changed, verified).otherwise(read)).otherwise(merged)
