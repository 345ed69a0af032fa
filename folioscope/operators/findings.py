"""Findings of a page: what text and pixels say together, what settlements say of the rest, checkboxes and their groups, in one ordered table.

Boxes are columns prefix_x, prefix_y, prefix_w and prefix_h in points; every table has doc and page columns named in `by`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1.5
#: Points of a side of the grid cells in which boxes meet.
CELL = 100.0
# Which text differences a pixel change may account for, and what groups of checkboxes ask for.
CLAIMS = {"unexpected": ("added", "changed"), "missing": ("missing", "changed")}
RULES = {"exactly-one": "exactly one box ticked", "at-least-one": "at least one box ticked", "at-most-one": "at most one box ticked"}


def near(a: str, b: str, slack: float = SLACK) -> Column:
    """Whether boxes a and b are less than slack apart."""
    part = lambda at, size: (F.col(f"{a}_{at}") < F.col(f"{b}_{at}") + F.col(f"{b}_{size}") + slack) & (F.col(f"{a}_{at}") + F.col(f"{a}_{size}") + slack > F.col(f"{b}_{at}"))
    return part("x", "w") & part("y", "h")


def share(a: str, b: str) -> Column:
    """Share of box a that lies in box b; 0 where a has no area."""
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{at}") + F.col(f"{a}_{size}"), F.col(f"{b}_{at}") + F.col(f"{b}_{size}")) - F.greatest(F.col(f"{a}_{at}"), F.col(f"{b}_{at}")))
    area = F.col(f"{a}_w") * F.col(f"{a}_h")
    return F.when(area > 0, side("x", "w") * side("y", "h") / area).otherwise(F.lit(0.0))


def meeting(a: DataFrame, b: DataFrame, by: list[str], pa: str, pb: str, cell: float = CELL, slack: float = SLACK) -> DataFrame:
    """Pairs of boxes on a page that are in the same cell and near: an equal-key join, where each pair meets once, in the cell of its upper left corner."""

    def spread(rows: DataFrame, p: str) -> DataFrame:
        for axis, size in (("x", "w"), ("y", "h")):
            low, high = F.floor((F.col(f"{p}_{axis}") - slack) / cell), F.floor((F.col(f"{p}_{axis}") + F.col(f"{p}_{size}") + slack) / cell)
            rows = rows.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
        return rows

    met = spread(a, pa).join(spread(b, pb), [*by, "_cx", "_cy"])
    first = [F.col(f"_c{axis}") == F.floor((F.greatest(F.col(f"{pa}_{axis}"), F.col(f"{pb}_{axis}")) - slack) / cell) for axis in "xy"]
    return met.where(near(pa, pb, slack) & first[0] & first[1]).drop("_cx", "_cy")


def regions_of(pages: DataFrame, regions: DataFrame, doc: list[str]) -> DataFrame:
    """Regions of each page (doc, page): those of that page, and those without a page, which every page of the document has."""
    own = pages.join(regions.where("page is not null"), [*doc, "page"])
    return own.unionByName(pages.join(regions.where("page is null").drop("page"), doc), allowMissingColumns=True)


def explanations(differences: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, diff, region, region_id) of the differences that an expected region explains: the first region in order in which half of an added text lies, or which is identified and near another difference.

    differences: by, diff, kind and box d; regions: by, region (their order), region_id, identified and box r.
    """
    hit = F.when(F.col("kind") == "added", share("d", "r") >= 0.5).otherwise(F.col("identified"))
    met = meeting(differences, regions.select(*by, "region", "region_id", "identified", "r_x", "r_y", "r_w", "r_h"), by, "d", "r").where(hit)
    return met.groupBy(*by, "diff").agg(F.min(F.struct("region", "region_id")).alias("first")).select(*by, "diff", "first.region", "first.region_id")


def claims(changes: DataFrame, differences: DataFrame, by: list[str]) -> DataFrame:
    """(by, diff, side, change): each difference belongs to the first change that may account for it - unexpected ones before missing ones, each by change.

    changes: by, side ('unexpected' or 'missing'), change (order within the side) and box c; differences: open ones, with kind. As every
    difference is claimed once and changes take all they can in order, the first one that can is the one that does.
    """
    may = reduce(lambda x, y: x | y, ((F.col("side") == side) & F.col("kind").isin(*kinds) for side, kinds in CLAIMS.items()))
    phase = F.when(F.col("side") == "unexpected", 0).otherwise(1)
    met = meeting(differences, changes.select(*by, "side", "change", "c_x", "c_y", "c_w", "c_h"), by, "d", "c").where(may)
    return met.groupBy(*by, "diff").agg(F.min(F.struct(phase.alias("phase"), "change", "side")).alias("first")).select(*by, "diff", "first.side", "first.change")


def settlement_key(text: Column, x: Column, y: Column) -> Column:
    """Runs are looked up by text and place to the point, halves rounded up."""
    return F.concat_ws("|", text, F.floor(x + 0.5).cast("string"), F.floor(y + 0.5).cast("string"))


def run_of(differences: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Each difference (by, diff, expected, d_x, d_y) with the print run of its text and place; of runs with one key the last counts, added texts have none."""
    keyed = runs.groupBy(*by, settlement_key(F.col("text"), F.col("x"), F.col("y")).alias("_key")).agg(F.max("run").alias("run"))
    own = differences.withColumn("_key", F.when(F.col("expected").isNotNull(), settlement_key(F.col("expected"), F.col("d_x"), F.col("d_y"))))
    return own.join(keyed, [*by, "_key"], "left").drop("_key")


def text_kind(kind: Column, verdict: Column) -> Column:
    return F.when(verdict == "unsettled", "text-unsettled").otherwise(F.concat(F.lit("text-"), kind))


def text_summary(kind: Column, expected: Column, found: Column, reason: Column, verdict: Column, steady: Column) -> Column:
    """What a difference that pixels didn't account for says."""
    said = (
        F.when(kind == "changed", F.concat(F.lit('Printed "'), expected, F.lit('" reads "'), found, F.lit('"'), F.when(reason == "numbers", " - its figures differ").otherwise("")))
        .when(kind == "missing", F.concat(F.lit('Printed "'), expected, F.lit('" could not be read')))
        .otherwise(F.concat(F.lit('Words the original does not have: "'), found, F.lit('"')))
    )
    more = F.concat(F.lit(" - the ink is identical and re-reading could not settle it"), F.when(steady, ", though each side read the same thing every time").otherwise(""))
    return F.when(verdict == "unsettled", F.concat(said, more)).otherwise(said)


def group_rule(rule: Column, ticked: Column, struck: Column, unread: Column) -> Column:
    """Whether a group of checkboxes is as its rule says: null if a box wasn't read, false if one is inked over, else by the number ticked."""
    held = F.when(rule == "exactly-one", ticked == 1).when(rule == "at-least-one", ticked >= 1).when(rule == "at-most-one", ticked <= 1)
    return F.when(unread > 0, F.lit(None).cast("boolean")).when(struck > 0, F.lit(False)).otherwise(held)


def checkbox_groups(groups: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Groups (by, group, rule, members) with satisfied, the ids ticked and struck in order, the box around the members that were read, and a sentence.

    boxes: by, id, state (empty, ticked, struck) and box b. A group without members asks about nothing ticked.
    """
    wanted = groups.select(*by, "group", "rule", F.posexplode_outer("members").alias("_at", "id"))
    read = wanted.join(boxes, [*by, "id"], "left")
    ids = lambda state: F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == state, F.struct("_at", "id")))), lambda x: x["id"])
    g = read.groupBy(*by, "group", "rule").agg(
        ids("ticked").alias("ticked"),
        ids("struck").alias("struck"),
        F.count_if(F.col("id").isNotNull() & F.col("state").isNull()).alias("_unread"),
        F.min("b_x").alias("x"),
        F.min("b_y").alias("y"),
        (F.max(F.col("b_x") + F.col("b_w")) - F.min("b_x")).alias("w"),
        (F.max(F.col("b_y") + F.col("b_h")) - F.min("b_y")).alias("h"),
    )
    n = F.size("ticked")
    said = F.when(n == 0, "none is").otherwise(F.concat(n.cast("string"), F.when(n == 1, " is: ").otherwise(" are: "), F.array_join("ticked", ", ")))
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule"))
    struck = F.when(F.size("struck") == 0, "").otherwise(F.concat(F.lit("; inked over, so unreadable: "), F.array_join("struck", ", ")))
    g = g.withColumn("summary", F.concat(F.lit('"'), F.col("group"), F.lit('" must have '), rule, F.lit(", and "), said, struck))
    return g.withColumn("satisfied", group_rule(F.col("rule"), n, F.size("struck"), F.col("_unread"))).drop("_unread")


def checkbox_finding(state: Column, before: Column, satisfied: Column) -> Column:
    """The kind of finding that a checkbox is, if any."""
    return F.when(~satisfied, "checkbox-mismatch").when((state == "struck") & (before != "struck"), "checkbox-struck").when((before != "empty") & (state == "empty"), "checkbox-cleared")


FINDING = ["kind", "x", "y", "w", "h", "corroborated", "summary", "subject"]


def correlated(differences: DataFrame, changes: DataFrame, regions: DataFrame, settled: DataFrame, checkboxes: DataFrame, by: list[str]) -> DataFrame:
    """All findings of pages in the order in which they are reported: unexpected ink, missing ink, texts, expected regions, checkboxes; position counts from 1.

    differences: by, diff (order), kind, expected, found, reason, box d. changes: by, side, change, ink_mm2, box c. regions: by, region (order),
    region_id, identified, overfilled, box r. settled: by, diff, verdict, steady. checkboxes: by, ord, id, state, before, expect, satisfied, box b.
    Explained differences and misreadings are no findings; a region that is a checkbox is reported as that.
    """
    box = lambda p: [F.col(f"{p}_{c}").alias(c) for c in "xywh"]
    none = F.lit(None).cast("string")
    open_ = differences.join(explanations(differences, regions, by), [*by, "diff"], "left_anti")
    taken = claims(changes, open_, by)
    words = taken.join(open_, [*by, "diff"]).groupBy(*by, "side", "change").agg(F.array_sort(F.collect_list(F.struct("diff", "found", "expected"))).alias("words"))
    c = changes.join(words, [*by, "side", "change"], "left")
    unexpected = F.col("side") == "unexpected"
    said = F.array_join(F.transform("words", lambda x: F.when(unexpected, x["found"]).otherwise(x["expected"])), " ")
    ink = F.concat(F.lit(" ("), F.format_string("%.1f", F.col("ink_mm2")), F.lit(" mm2)"))
    text = F.when(F.col("words").isNotNull(), F.when(unexpected, F.concat(F.lit('Ink added where nothing was expected, reading "'), said, F.lit('"'))).otherwise(F.concat(F.lit('Printed ink lost, and with it "'), said, F.lit('"'))))
    text = F.coalesce(text, F.concat(F.when(unexpected, "Ink added where nothing was expected").otherwise("Printed ink lost"), ink))
    pixels = c.select(*by, F.when(unexpected, 0).otherwise(1).alias("_part"), F.col("change").cast("long").alias("_ord"), F.when(unexpected, "unexpected-mark").otherwise("missing-ink").alias("kind"), *box("c"), F.col("words").isNotNull().alias("corroborated"), text.alias("summary"), none.alias("subject"))
    left = open_.join(taken.select(*by, "diff"), [*by, "diff"], "left_anti").join(settled.select(*by, "diff", "verdict", "steady"), [*by, "diff"], "left").where("verdict is null or verdict != 'misread'")
    verdict, steady = F.coalesce("verdict", F.lit("")), F.coalesce("steady", F.lit(False))
    texts = left.select(*by, F.lit(2).alias("_part"), F.col("diff").cast("long").alias("_ord"), text_kind(F.col("kind"), verdict).alias("kind"), *box("d"), F.lit(False).alias("corroborated"), text_summary(F.col("kind"), F.col("expected"), F.col("found"), F.col("reason"), verdict, steady).alias("summary"), none.alias("subject"))
    empty = regions.where("not identified").join(checkboxes.select(*by, F.col("id").alias("region_id")), [*by, "region_id"], "left_anti")
    over = F.col("overfilled")
    expected = empty.select(*by, F.lit(3).alias("_part"), F.col("region").cast("long").alias("_ord"), F.when(over, "expected-overfilled").otherwise("expected-empty").alias("kind"), *box("r"), F.lit(False).alias("corroborated"), F.concat(F.lit('"'), F.col("region_id"), F.when(over, '" is covered, not filled in').otherwise('" was left empty')).alias("summary"), F.col("region_id").alias("subject"))
    kind = checkbox_finding(F.col("state"), F.col("before"), F.col("satisfied"))
    about = F.when(F.col("kind") == "checkbox-mismatch", F.concat(F.lit('" must be '), F.col("expect"), F.lit(", and is "), F.col("state"))).when(F.col("kind") == "checkbox-struck", '" is inked over: whether it is ticked cannot be told').otherwise('" was ticked on the original and is empty on the scan')
    ticks = checkboxes.withColumn("kind", kind).where("kind is not null").select(*by, F.lit(4).alias("_part"), F.col("ord").cast("long").alias("_ord"), "kind", *box("b"), F.lit(False).alias("corroborated"), F.concat(F.lit('"'), F.col("id"), about).alias("summary"), F.col("id").alias("subject"))
    every = reduce(DataFrame.unionByName, [pixels, texts, expected, ticks])
    order = Window.partitionBy(*by).orderBy("_part", "_ord", "kind", "summary")
    return every.withColumn("position", F.row_number().over(order)).drop("_part", "_ord")
