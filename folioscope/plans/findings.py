"""Queries of findings, words, fields, pages and numbers over the driver's tables as stand-ins: line items as boxes on the page of their order, messages as printed pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from folioscope.functions import ink as I
from folioscope.functions import numbers as N
from folioscope.functions import raster as R
from folioscope.operators import calibrate as C
from folioscope.operators import fields, findings, words
from folioscope.operators import measures as M
from folioscope.operators import pages as P
from folioscope.plans.policies import _BOX, _boxes, r6
from folioscope.plans.rasters import pages as rasters
from folioscope.plans.rasters import per_page
from folioscope.plans.registry import query
from folioscope.plans.texts import read


@query("sample_spread", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 3 OR i IN (0, floor((n - 1) / 2 + 0.5), n - 1)")
def sample_spread(spark, d):
    return P.sample_spread(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("page_positions", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def page_positions(spark, d):
    return P.positions(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("page_batches", "SELECT l_suppkey, l_orderkey, l_linenumber, ((row_number() OVER w - 1) // 4 + 1)::BIGINT AS batch, ceil(count(*) OVER (PARTITION BY l_suppkey) / 4)::BIGINT AS batches FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber)")
def page_batches(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return P.batches(rows, ["l_suppkey"], "at").drop("at")


@query(
    "best_recipe",
    """SELECT l_orderkey, recipe, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, recipe) AS k FROM (
  SELECT l_orderkey, l_returnflag AS recipe, CASE WHEN sum(c) > 0 THEN sum(s * c) / sum(c) ELSE sum(s) / count(*) END AS score FROM (SELECT *, round(l_discount * 100) AS s, greatest(0, round(l_quantity) - 10) AS c FROM lineitem) GROUP BY ALL)) WHERE k = 1""",
)
def best_recipe(spark, d):
    tried = read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("recipe"), F.ascii("l_returnflag").alias("ord"), F.round(F.col("l_discount") * 100).alias("score"), F.greatest(F.lit(0.0), F.round("l_quantity") - 10).alias("characters"))
    got = P.best_recipe(tried, ["l_orderkey"])
    return got.select("l_orderkey", "recipe", r6(F.col("score")).alias("score"))


_VIEW = "(SELECT p_partkey, 10::DOUBLE AS x0, 20::DOUBLE AS y0, 310::DOUBLE + p_size AS x1, 420::DOUBLE AS y1, (p_partkey % 4) * 90 AS turn, p_size * 3::DOUBLE AS x, p_retailprice / 10 AS y FROM part)"


@query(
    "viewport_points",
    f"""SELECT p_partkey, round(CASE turn WHEN 0 THEN x - x0 WHEN 90 THEN y - y0 WHEN 180 THEN x1 - x ELSE y1 - y END, 6) AS dx, round(CASE turn WHEN 0 THEN y1 - y WHEN 90 THEN x - x0 WHEN 180 THEN y - y0 ELSE x1 - x END, 6) AS dy,
  round(x, 6) AS bx, round(y, 6) AS by, CASE WHEN turn IN (90, 270) THEN y1 - y0 ELSE x1 - x0 END AS width FROM {_VIEW}""",
)
def viewport_points(spark, d):
    c = read(spark, d, "part").select("p_partkey", F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), (310.0 + F.col("p_size")).alias("x1"), F.lit(420.0).alias("y1"), ((F.col("p_partkey") % 4) * 90 - 360).alias("turn"), (F.col("p_size") * 3.0).alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    box = [F.col(k) for k in ("x0", "y0", "x1", "y1", "turn")]
    c = c.withColumn("m", P.viewport(*box)).withColumn("to", P.to_display(F.col("m"), F.col("x"), F.col("y"))).withColumn("back", P.to_user_space(F.col("m"), F.col("to.x"), F.col("to.y")))
    return c.select("p_partkey", r6(F.col("to.x")).alias("dx"), r6(F.col("to.y")).alias("dy"), r6(F.col("back.x")).alias("bx"), r6(F.col("back.y")).alias("by"), P.viewport_size(*box)["width"].alias("width"))


@query(
    "date_utc",
    "SELECT o_orderkey, epoch_ms((make_date(y, 1, 1) + to_months((m - 1)::INTEGER))::TIMESTAMP)::DOUBLE + (dd - 1) * 86400000.0 + h * 3600000.0 + 59 * 60000.0 + 61000.0 AS ms FROM (SELECT o_orderkey, 1900 + o_custkey % 200 AS y, o_custkey % 40 - 12 AS m, o_orderkey % 90 - 30 AS dd, o_orderkey % 50 AS h FROM orders)",
)
def date_utc(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", N.date_utc(1900 + F.col("o_custkey") % 200, F.col("o_custkey") % 40 - 13, F.col("o_orderkey") % 90 - 30, F.col("o_orderkey") % 50, F.lit(59), F.lit(61)).alias("ms"))


@query(
    "int32_wrap",
    """SELECT l_orderkey, l_linenumber, (CASE WHEN m >= 2147483648 THEN m - 4294967296 ELSE m END)::INTEGER AS wrapped, (CASE WHEN p >= 2147483648 THEN p - 4294967296 ELSE p END)::INTEGER AS product FROM (
  SELECT l_orderkey, l_linenumber, ((x % 4294967296) + 4294967296) % 4294967296 AS m, (l_orderkey::HUGEINT * 2654435 * (l_partkey::HUGEINT * 40503)) % 4294967296 AS p FROM (SELECT *, trunc((l_extendedprice - 30000) * 1000000)::HUGEINT AS x FROM lineitem))""",
)
def int32_wrap(spark, d):
    li = read(spark, d, "lineitem")
    a, b = N.int32(F.col("l_orderkey") * 2654435.0), N.int32(F.col("l_partkey") * 40503.0)
    return li.select("l_orderkey", "l_linenumber", N.int32((F.col("l_extendedprice") - 30000) * 1000000).alias("wrapped"), N.multiply32(a, b).alias("product"))


@query("text_number", "SELECT o_orderkey, (CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN o_custkey WHEN 2 THEN 0 WHEN 3 THEN -o_custkey * 1000.0 ELSE 5 END)::DOUBLE AS value FROM orders")
def text_number(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    t = F.when(k == 0, F.concat(F.lit(" +"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\n"))).when(k == 1, F.concat(F.lit("0x"), F.hex(c))).when(k == 2, F.lit(" \t ")).when(k == 3, F.concat(F.lit("-"), c.cast("string"), F.lit(".e3"))).otherwise(F.lit("0b101"))
    return read(spark, d, "orders").select("o_orderkey", N.text_number(t).alias("value"))


#: Line items as differences (line status F) and changes of pixels (O); flags are kinds and sides.
def _differences(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "N", "missing").otherwise("changed")
    b = _boxes(spark, d).where("l_linestatus = 'F' or l_partkey % 3 = 0")
    return b.select("page", F.col("box").alias("diff"), kind.alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("expected"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("found"), F.lit("text").alias("reason"), *(F.col(c).alias(f"d_{c}") for c in "xywh"))


def _changes(spark, d):
    b = _boxes(spark, d).where("l_linestatus = 'O' or l_partkey % 3 = 1")
    return b.select("page", F.when(F.col("l_partkey") % 2 == 0, "unexpected").otherwise("missing").alias("side"), F.col("box").alias("change"), (F.col("w") * F.col("h") / 100).alias("ink_mm2"), *(F.col(c).alias(f"c_{c}") for c in "xywh"))


def _regions(spark, d):
    b = _boxes(spark, d).where("l_partkey % 3 = 2")
    return b.select("page", F.col("box").alias("region"), F.concat(F.lit("r"), F.col("box").cast("string")).alias("region_id"), (F.col("l_returnflag") == "N").alias("identified"), (F.col("l_linestatus") == "F").alias("overfilled"), *(F.col(c).alias(f"r_{c}") for c in "xywh"))


_NEAR = "f.x < c.x + c.w + 1.5 AND f.x + f.w + 1.5 > c.x AND f.y < c.y + c.h + 1.5 AND f.y + f.h + 1.5 > c.y"


@query(
    "claim_findings",
    f"""WITH b AS (SELECT {_BOX}, l_returnflag, l_linestatus, l_partkey FROM lineitem), j AS (SELECT f.page, f.box AS diff, CASE WHEN c.l_partkey % 2 = 0 THEN 'unexpected' ELSE 'missing' END AS side, c.box AS change FROM b f JOIN b c ON f.page = c.page
  AND (f.l_linestatus = 'F' OR f.l_partkey % 3 = 0) AND (c.l_linestatus = 'O' OR c.l_partkey % 3 = 1) AND {_NEAR} AND (f.l_returnflag NOT IN ('A', 'N') OR (f.l_returnflag = 'A') = (c.l_partkey % 2 = 0)))
SELECT page, diff, side, change FROM (SELECT *, row_number() OVER (PARTITION BY page, diff ORDER BY side DESC, change) AS k FROM j) WHERE k = 1""",
)
def claim_findings(spark, d):
    """Unexpected ink takes added and changed texts, missing ink missing and changed ones, unexpected first."""
    return findings.claims(_changes(spark, d), _differences(spark, d), ["page"])


@query(
    "explain_by_region",
    f"""WITH b AS (SELECT {_BOX}, l_returnflag, l_linestatus, l_partkey FROM lineitem), j AS (SELECT f.page, f.box AS diff, c.box AS region, f.l_returnflag = 'A' AS added, c.l_returnflag = 'N' AS identified,
  greatest(0, least(f.x + f.w, c.x + c.w) - greatest(f.x, c.x)) * greatest(0, least(f.y + f.h, c.y + c.h) - greatest(f.y, c.y)) / (f.w * f.h) AS part FROM b f JOIN b c ON f.page = c.page AND (f.l_linestatus = 'F' OR f.l_partkey % 3 = 0) AND c.l_partkey % 3 = 2 AND {_NEAR})
SELECT page, diff, min(region) AS region, 'r' || min(region) AS region_id FROM j WHERE CASE WHEN added THEN part >= 0.5 ELSE identified END GROUP BY ALL""",
)
def explain_by_region(spark, d):
    return findings.explanations(_differences(spark, d), _regions(spark, d), ["page"])


@query("correlate_page_findings")
def correlate_page_findings(spark, d):
    """All findings of all pages in order; every seventh difference was settled as a misreading, every eleventh not at all."""
    diffs = _differences(spark, d)
    verdict = F.when((F.col("page") + F.col("diff")) % 7 == 0, "misread").when((F.col("page") + F.col("diff")) % 11 == 0, "unsettled")
    settled = diffs.select("page", "diff", verdict.alias("verdict"), (F.col("diff") % 2 == 0).alias("steady")).where("verdict is not null")
    b = _boxes(spark, d).where("l_partkey % 5 = 0")
    ticks = b.select("page", F.col("box").alias("ord"), F.concat(F.lit("r"), F.col("box").cast("string")).alias("id"), F.when(F.col("l_returnflag") == "A", "ticked").when(F.col("l_returnflag") == "R", "struck").otherwise("empty").alias("state"), F.when(F.col("l_linestatus") == "F", "ticked").otherwise("empty").alias("before"), F.lit("ticked").alias("expect"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag") == "A").alias("satisfied"), *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    got = findings.correlated(diffs, _changes(spark, d), _regions(spark, d), settled, ticks, ["page"])
    return got.select("page", "position", "kind", *(r6(F.col(c)).alias(c) for c in "xywh"), "corroborated", "summary", "subject")


@query("settlement_lookup", f"""WITH b AS (SELECT {_BOX}, l_returnflag, l_partkey FROM lineitem), r AS (SELECT page, 'p' || l_partkey % 7 || '|' || floor(x / 40 + 0.5)::BIGINT || '|' || floor(y / 70 + 0.5)::BIGINT AS key, max(box) AS run FROM b GROUP BY ALL)
SELECT b.page, b.box AS diff, r.run FROM b LEFT JOIN r ON r.page = b.page AND b.l_returnflag <> 'A' AND r.key = 'p' || b.l_partkey % 7 || '|' || floor(b.x / 40 + 0.5)::BIGINT || '|' || floor(b.y / 70 + 0.5)::BIGINT""")
def settlement_lookup(spark, d):
    b = _boxes(spark, d).withColumn("t", F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string"))).withColumn("px", F.col("x") / 40).withColumn("py", F.col("y") / 70)
    runs = b.select("page", F.col("box").alias("run"), F.col("t").alias("text"), F.col("px").alias("x"), F.col("py").alias("y"))
    diffs = b.select("page", F.col("box").alias("diff"), F.when(F.col("l_returnflag") != "A", F.col("t")).alias("expected"), F.col("px").alias("d_x"), F.col("py").alias("d_y"))
    return findings.run_of(diffs, runs, ["page"]).select("page", "diff", "run")


@query(
    "group_findings",
    """SELECT o_orderkey AS page, rule, satisfied, '"g" must have ' || said || ', and ' || CASE WHEN n = 0 THEN 'none is' ELSE n || CASE WHEN n = 1 THEN ' is: ' ELSE ' are: ' END || ticked END || CASE WHEN s = 0 THEN '' ELSE '; inked over, so unreadable: ' || struck END AS summary FROM (
  SELECT *, CASE rule WHEN 'exactly-one' THEN 'exactly one box ticked' WHEN 'at-least-one' THEN 'at least one box ticked' ELSE 'at most one box ticked' END AS said,
    CASE WHEN unread > 0 THEN NULL WHEN s > 0 THEN false WHEN rule = 'exactly-one' THEN n = 1 WHEN rule = 'at-least-one' THEN n >= 1 ELSE n <= 1 END AS satisfied FROM (
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'exactly-one' WHEN 1 THEN 'at-least-one' ELSE 'at-most-one' END AS rule, 3 - count(DISTINCT l_linenumber) AS unread, count(*) FILTER (l_returnflag = 'A') AS n, count(*) FILTER (l_returnflag = 'R') AS s,
      string_agg('b' || l_linenumber, ', ' ORDER BY l_linenumber) FILTER (l_returnflag = 'A') AS ticked, string_agg('b' || l_linenumber, ', ' ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS struck
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber <= 3 GROUP BY 1))""",
)
def group_findings(spark, d):
    """Groups of the first three boxes of each page."""
    rule = F.when(F.col("o_orderkey") % 3 == 0, "exactly-one").when(F.col("o_orderkey") % 3 == 1, "at-least-one").otherwise("at-most-one")
    groups = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.lit("g").alias("group"), rule.alias("rule"), F.array(F.lit("b1"), F.lit("b2"), F.lit("b3")).alias("members"))
    state = F.when(F.col("l_returnflag") == "A", "ticked").when(F.col("l_returnflag") == "R", "struck").otherwise("empty")
    boxes = _boxes(spark, d).select("page", F.concat(F.lit("b"), F.col("box").cast("string")).alias("id"), state.alias("state"), *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    return findings.checkbox_groups(groups, boxes, ["page"]).select("page", "rule", "satisfied", "summary")


@query("match_words")
def match_words(spark, d):
    """Line items of status O as printed runs, those of status F as words read on the same page: missing, changed and added texts."""
    b = _boxes(spark, d)
    text = F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string"))
    runs = b.where("l_linestatus = 'O'").select("page", F.col("box").alias("run"), text.alias("text"), *(F.col(c).alias(f"r_{c}") for c in "xywh"))
    read_ = b.where("l_linestatus = 'F'").select("page", F.col("box").alias("word"), F.floor(F.col("y") / 20).alias("line"), text.alias("text"), (F.col("l_partkey") % 100).cast("double").alias("confidence"), *(F.col(c).alias(f"w_{c}") for c in "xywh"))
    got = words.matched(read_, runs, ["page"])
    return got.select("page", "ord", "kind", "expected", "found", "reason", *(r6(F.col(c)).alias(c) for c in ("similarity", *"xywh")))


@query("glyph_templates", """SELECT l_orderkey, l_linenumber, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber) AS k FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag || '|' || (floor(l_quantity / 3 * 2 + 0.5) / 2) || '|' || (((floor(l_tax * 5000 / 90 + 0.5)::BIGINT % 4) + 4) % 4) * 90 || '|' || l_linestatus AS key FROM lineitem)) WHERE k <= 4""")
def glyph_templates(spark, d):
    g = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", words.template_key(F.col("l_returnflag"), F.col("l_quantity") / 3, F.col("l_tax") * 5000, F.col("l_linestatus")).alias("key"))
    return words.templates(g, "key", ["l_orderkey", "l_linenumber"])


@query("locate_fields")
def locate_fields(spark, d):
    """Each message as a page whose lines are runs; the first three words of a conversation's first message are a label, with two fields beside it."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    run = lambda x, i: F.struct(x.alias("text"), F.lit(20.0).alias("x"), (i * 14.0 + 20.0).alias("y"), (F.length(x) * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit(0.0).alias("angle"))
    pages = c.select("doc", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.filter(F.transform("lines", run), lambda r: F.trim(r["text"]) != "").alias("runs"))
    field = lambda name, dx, dy: F.struct(F.lit(name).alias("id"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(120.0).alias("width"), F.lit(14.0).alias("height"))
    label = F.concat_ws(" ", F.slice(F.split(F.concat_ws(" ", "lines"), r"\s+"), 1, 3))
    specs = c.where("page = 0 or page = 1").groupBy("doc").agg(F.min_by(label, "page").alias("anchor")).select("doc", F.lit(0).alias("spec"), "anchor", F.lit(None).cast("long").alias("page"), F.lit(1).cast("long").alias("occurrence"), F.lit("bottom-left").alias("corner"), F.array(field("name", 0.0, 4.0), field("date", 60.0, 10.0)).alias("fields"))
    regions, problems = fields.resolved(pages, specs)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    found = regions.select("doc", "page", "id", *(r6(F.col(k)).alias(k) for k in "xywh"), none("problem", "string"))
    return found.unionByName(problems.select("doc", "page", "id", *(none(k, "double") for k in "xywh"), F.col("kind").alias("problem")))


@query("raster_regions")
def raster_regions(spark, d):
    """Ink of the lower half of synthetic pages against their registered scans with a stroke more: probe, region, extent, corners."""

    def f(original, scan, m):
        marked = scan.copy()
        marked[500:506, 200:300] = 0.1
        printed = R.ink_map(original)
        a = R.binarize(printed)
        back = R.warp(marked, R.estimate_matrix(original, marked, mask=a), original.shape)
        b = R.binarize(R.ink_map(back))
        masks = I.Masks(a, b)
        h, w = a.shape
        rect = (0, h / 2, w, h / 2)
        ink = I.region_ink(masks.added, rect, 8, 20)
        extent = I.content_extent(printed)
        small, _ = I.downscale(back, 200)
        return I.probe(masks, tuple(v * 72 / 150 for v in rect))["added"], I.region_report(masks, rect)["added"], ink["changes"], ink["pixels"], extent["width"], extent["height"], len(I.corners(small, 0.2)), I.polarity(original, 150, (10, 10, 150, 150))

    return per_page(rasters(spark, d), f, "page long, added_mm2 double, added_share double, changes int, pixels int, extent_width double, extent_height double, corners int, polarity string")


_AUDIT = """pages AS (SELECT l_suppkey AS sample, 1 - l_discount AS text_score FROM lineitem), found AS (SELECT l_suppkey AS sample, l_returnflag = 'R' AS missing, l_quantity / 4 AS ink, l_partkey % 997 = 0 AS txt FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 12),
worst AS (SELECT s_suppkey AS sample, s_suppkey % 2 = 0 AS genuine, (SELECT min(text_score) FROM pages p WHERE p.sample = s_suppkey) AS score, (SELECT max(ink) FROM found f WHERE f.sample = s_suppkey AND NOT txt AND NOT missing) AS change,
  (SELECT max(ink) FROM found f WHERE f.sample = s_suppkey AND NOT txt AND missing) AS lost, coalesce((SELECT bool_or(txt) FROM found f WHERE f.sample = s_suppkey), false) AS always FROM supplier),
grid AS (SELECT (row_number() OVER (ORDER BY t, c, m) - 1)::INTEGER AS point, t, c, m FROM (SELECT unnest([0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t), (SELECT unnest([1, 2, 4, 8])::DOUBLE AS c), (SELECT unnest([4, 8, 16])::DOUBLE AS m)),
tried AS (SELECT point, sample, genuine, coalesce(score < t, false) OR coalesce(change >= c, false) OR coalesce(lost >= m, false) OR always AS review FROM worst, grid WHERE c >= 2)"""


def _corpus(spark, d):
    li = read(spark, d, "lineitem")
    found = li.where("l_linestatus = 'F' and l_quantity < 12").select(F.col("l_suppkey").alias("sample"), F.when(F.col("l_returnflag") == "R", "missing-ink").otherwise("unexpected-mark").alias("kind"), (F.col("l_quantity") / 4).alias("ink_mm2"), (F.col("l_partkey") % 997 == 0).alias("has_text"))
    pages = C.corpus_pages(li.select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("page"), (1 - F.col("l_discount")).alias("text_score")), found)
    samples = read(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") % 2 == 0).alias("genuine"), F.when(F.col("s_suppkey") % 3 == 0, 1.5).alias("floor_change"), F.lit(None).cast("double").alias("floor_missing"))
    points, _ = C.reachable(C.grid(spark), samples)
    return pages, samples, points


@query("calibrate_corpus", f"WITH {_AUDIT} SELECT point, count(*) FILTER (genuine) AS genuine, count(*) FILTER (NOT genuine) AS altered, count(*) FILTER (NOT genuine AND NOT review) AS false_accepts, count(*) FILTER (genuine AND review) AS false_reviews FROM tried GROUP BY point")
def calibrate_corpus(spark, d):
    """Suppliers as audited documents; findings were gathered from 1.5 mm2 on, so smaller limits can't be judged."""
    return C.sweep(*_corpus(spark, d)).select("point", "genuine", "altered", "false_accepts", "false_reviews")


@query("calibration_failures", f"WITH {_AUDIT} SELECT point, sample, CASE WHEN genuine THEN 'false-review' ELSE 'false-accept' END AS failure FROM tried WHERE genuine = review")
def calibration_failures(spark, d):
    return C.failing(*_corpus(spark, d))


@query(
    "pdf_text_layer",
    """SELECT conv_id, turn, greatest(1, ceil(len(l) / 50))::BIGINT AS pages, len(list_filter(l, lambda x: trim(x) <> ''))::BIGINT AS runs, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS characters, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'vector' END AS kind
  FROM (SELECT conv_id, turn, text, string_split(text, chr(10)) AS l FROM conversations)""",
)
def pdf_text_layer(spark, d):
    """Each message as a document of its own, fifty lines to a page, written and read back: pages, runs and characters of its text layer."""
    from folioscope.sources import pdfdoc

    def write(batches):
        for b in batches:
            out = []
            for c, t, x in zip(b.conv_id, b.turn, b.text, strict=True):
                lines = (x or "").split("\n")
                made = [{"width": 612, "height": 792, "texts": [(line, 36, 36 + 14 * i, 9, True) for i, line in enumerate(lines[k : k + 50])]} for k in range(0, len(lines), 50)]
                out.append((f"{c}/{t}", pdfdoc.created(made)))
            yield pd.DataFrame(out, columns=["path", "content"])

    made = read(spark, d, "conversations").select("conv_id", "turn", "text").mapInPandas(write, "path string, content binary")
    p = pdfdoc.read_pages(made).withColumn("at", F.split("path", "/"))
    g = p.groupBy(F.col("at")[0].cast("long").alias("conv_id"), F.col("at")[1].cast("long").alias("turn"))
    return g.agg(F.max("pages").cast("long").alias("pages"), F.sum(F.size("runs")).alias("runs"), F.sum("characters").alias("characters"), F.max("kind").alias("kind"))


@query("pdf_sniff_window", "SELECT page_id, page_id % 1500 = 0 AS exact, page_id % 1500 <= 1019 AS early FROM pages")
def pdf_sniff_window(spark, d):
    """The raw pages behind a PDF header that starts further and further in: a session takes it at the first byte only, a merger within the first kilobyte."""
    from folioscope.sources import pdf

    c = F.encode(F.concat(F.repeat(F.lit("x"), (F.col("page_id") % 1500).cast("int")), F.lit("%PDF-1.7\n"), F.coalesce("html", F.lit(""))), "UTF-8")
    return read(spark, d, "pages").select("page_id", pdf.is_pdf(c).alias("exact"), pdf.is_pdf_to_merge(c).alias("early"))


@query("pair_by_index", "SELECT coalesce(a.l_orderkey, b.o_orderkey) AS doc, CASE WHEN a.l_orderkey IS NULL THEN 'returned' WHEN b.o_orderkey IS NULL THEN 'issued' ELSE 'both' END AS side, coalesce(a.l_linenumber, b.page) AS page FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a FULL JOIN (SELECT o_orderkey, unnest(range(1, 2 + o_custkey % 5)) AS page FROM orders) b ON a.l_orderkey = b.o_orderkey AND a.l_linenumber = b.page")
def pair_by_index(spark, d):
    """Line items as issued pages, one to five returned pages of each order: pairs by number, and what is left on either side."""
    issued = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"))
    returned = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("o_custkey") % 5)).alias("page"))
    both, left = M.paired(issued, returned, ["doc"])
    return both.select("doc", F.lit("both").alias("side"), F.col("issued").alias("page")).unionByName(left.select("doc", "side", "page"))
