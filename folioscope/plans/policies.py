"""Decision queries over the driver's tables as stand-ins: orders and parts as page metadata, line items as boxes, labels as ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import boxes as B
from folioscope.operators import calibrate as C
from folioscope.operators import measures as M
from folioscope.operators import policies as P
from folioscope.plans.registry import query
from folioscope.plans.texts import read


def r6(c):
    return F.round(c, 6)


_Q = """samples AS (SELECT l.doc_id AS sample, l.quality = 1 AS genuine FROM labels l),
pages AS (SELECT doc_id AS sample, round(len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')), 6) AS text_score,
  length(regexp_replace(text, '[^#$%&*!|]', '', 'g'))::DOUBLE AS worst_change, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS worst_missing FROM documents),
grid AS (SELECT (row_number() OVER (ORDER BY t, c, m) - 1)::INTEGER AS point, t AS min_text, c AS min_change, m AS min_missing
  FROM (SELECT unnest([0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t), (SELECT unnest([1, 2, 4, 8])::DOUBLE AS c), (SELECT unnest([4, 8, 16])::DOUBLE AS m)),
tried AS (SELECT g.*, s.genuine, coalesce(p.text_score < min_text, false) OR coalesce(worst_change >= min_change, false) OR coalesce(worst_missing >= min_missing, false) AS review
  FROM samples s LEFT JOIN (SELECT sample, min(text_score) AS text_score, max(worst_change) AS worst_change, max(worst_missing) AS worst_missing FROM pages GROUP BY sample) p ON p.sample = s.sample, grid g),
swept AS (SELECT point, min_text, min_change, min_missing, count(*) FILTER (genuine) AS genuine, count(*) FILTER (NOT genuine) AS altered, count(*) FILTER (NOT genuine AND NOT review) AS false_accepts, count(*) FILTER (genuine AND review) AS false_reviews FROM tried GROUP BY ALL)"""


def _upper(a: str, b: str) -> str:
    z = C.Z
    return f"CASE WHEN {b} > 0 THEN least(1.0, ({a}::DOUBLE / {b} + {z * z} / (2 * {b}) + {z} * sqrt(greatest(0, {a}::DOUBLE / {b} * (1 - {a}::DOUBLE / {b}) / {b} + {z * z} / (4.0 * {b} * {b})))) / (1 + {z * z} / {b})) END"


def _swept(spark, d):
    docs = read(spark, d, "documents").withColumn("w", F.split("text", " "))
    pages = docs.select(
        F.col("doc_id").alias("sample"),
        r6(F.size(F.array_distinct("w")) / F.size("w")).alias("text_score"),
        F.length(F.regexp_replace("text", "[^#$%&*!|]", "")).cast("double").alias("worst_change"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double").alias("worst_missing"),
        F.lit(False).alias("always"),
    )
    samples = read(spark, d, "labels").select(F.col("doc_id").alias("sample"), (F.col("quality") == 1).alias("genuine"))
    return C.sweep(pages, samples, C.grid(spark))


@query(
    "calibrate_grid",
    f"""WITH {_Q} SELECT point, min_text, min_change, min_missing, genuine, altered, false_accepts, false_reviews,
  round(CASE WHEN altered > 0 THEN false_accepts::DOUBLE / altered END, 6) AS accept_rate, round(CASE WHEN genuine > 0 THEN false_reviews::DOUBLE / genuine END, 6) AS review_rate,
  round({_upper('false_accepts', 'altered')}, 6) AS accept_upper, round({_upper('false_reviews', 'genuine')}, 6) AS review_upper,
  (row_number() OVER (ORDER BY false_accepts, false_reviews, point))::INTEGER AS rank, row_number() OVER (ORDER BY false_accepts, false_reviews, point) = 1 AND false_accepts = 0 AND altered > 0 AS best FROM swept""",
)
def calibrate_grid(spark, d):
    s = C.ranked(_swept(spark, d))
    return s.select(*(r6(F.col(c)).alias(c) if c.endswith(("rate", "upper")) else F.col(c) for c in s.columns))


@query("wilson_upper", f"SELECT l_shipmode_key, n, k, round({_upper('k', 'n')}, 6) AS upper_bound FROM (SELECT l_suppkey AS l_shipmode_key, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY l_suppkey)")
def wilson(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("l_shipmode_key")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return g.withColumn("upper_bound", r6(C.wilson_upper(F.col("k"), F.col("n"))))


@query("finding_counts", "SELECT l_returnflag AS kind, l_linestatus AS side, count(*) AS findings, count(DISTINCT l_orderkey) AS pages FROM lineitem GROUP BY ALL")
def finding_counts(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("side")).agg(F.count("*").alias("findings"), F.countDistinct("l_orderkey").alias("pages"))


@query("combine_summaries", "SELECT kind, sum(n)::BIGINT AS n FROM (SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1) GROUP BY kind")
def combine_summaries(spark, d):
    a = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    b = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(b).groupBy("kind").agg(F.sum("n").alias("n"))


@query("page_selection", "SELECT c_custkey, list_aggregate(list_transform(range(1 + c_custkey % 5, least(2 + c_custkey % 5 + c_custkey % 3, 9)), lambda x: x::VARCHAR), 'string_agg', ',') AS pages FROM customer")
def page_selection(spark, d):
    """Pages 'a-b' of documents of eight pages, by the distinct selections there are."""
    c = read(spark, d, "customer").select("c_custkey", (1 + F.col("c_custkey") % 5).alias("a"), F.least(1 + F.col("c_custkey") % 5 + F.col("c_custkey") % 3, F.lit(8)).alias("b"))
    rows = [(a, b, ",".join(map(str, P.select_pages(f"{a}-{b}", 8)))) for a in range(1, 9) for b in range(a, 9)]
    # At most 36 selections of eight pages.
    return c.join(F.broadcast(spark.createDataFrame(rows, "a long, b long, pages string")), ["a", "b"]).select("c_custkey", "pages")


@query("pair_pages", "SELECT a.conv_id, a.turn AS page, length(a.text)::INTEGER AS issued, length(b.text)::INTEGER AS returned FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn * 2 = b.turn")
def pair_pages(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    b = c.where("turn % 2 = 0").select("conv_id", (F.col("turn") / 2).cast("long").alias("turn"), F.col("n").alias("returned"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("page"), F.col("n").alias("issued"), "returned")


@query("unpaired_pages", "SELECT 'issued' AS side, conv_id, turn FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn * 2) UNION ALL SELECT 'returned', conv_id, turn FROM conversations a WHERE turn % 2 = 1")
def unpaired_pages(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn")
    left = c.join(c.where("turn % 2 = 0").select("conv_id", (F.col("turn") / 2).cast("long").alias("turn")), ["conv_id", "turn"], "left_anti")
    return left.select(F.lit("issued").alias("side"), "conv_id", "turn").unionByName(c.where("turn % 2 = 1").select(F.lit("returned").alias("side"), "conv_id", "turn"))


@query("dpi_policy", "SELECT o_orderkey, round(least(greatest(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500 END, 200.0), 72.0), 400.0), 6) AS dpi FROM orders")
def dpi_policy(spark, d):
    return read(spark, d, "orders").select("o_orderkey", r6(P.native_dpi(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500))).alias("dpi"))


@query(
    "dpi_match",
    "SELECT p_partkey, round(least(greatest(150 * CASE WHEN abs(r - 1) <= 0.1 THEN 1.0 ELSE r END, 72.0), 400.0), 6) AS dpi FROM (SELECT p_partkey, least(greatest(600.0, 500 + p_size * 10) / greatest(612.0, p_retailprice), least(600.0, 500 + p_size * 10) / least(612.0, p_retailprice)) AS r FROM part)",
)
def dpi_match(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(P.matched_dpi(F.lit(150.0), F.lit(600.0), 500.0 + F.col("p_size") * 10, F.lit(612.0), F.col("p_retailprice"))).alias("dpi"))


@query("bleed_policy", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 2 = 0 THEN 2 * p_size END, 6)::DOUBLE AS bleed FROM part")
def bleed_policy(spark, d):
    return read(spark, d, "part").select("p_partkey", P.resolved_bleed(F.when(F.col("p_size") % 3 == 0, F.col("p_size")).cast("double"), F.when(F.col("p_size") % 2 == 0, 2 * F.col("p_size")).cast("double")).alias("bleed"))


@query("page_kind", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.8 AND l_quantity > 25 THEN 'scanned-with-text-layer' WHEN l_discount * 10 >= 0.8 THEN 'scanned' WHEN l_quantity > 25 OR l_tax > 0.04 OR l_discount > 0 THEN 'vector' ELSE 'empty' END AS kind FROM lineitem")
def page_kind(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.page_kind(F.col("l_discount") * 10, F.greatest(F.col("l_quantity") - 25, F.lit(0.0)), F.col("l_tax") > 0.04).alias("kind"))


@query(
    "place_image",
    "SELECT p_partkey, round(s, 6) AS scale, round((pw - w * s) / 2, 6) AS x, round((ph - h * s) / 2, 6) AS y FROM (SELECT *, least((pw - 40) / w, (ph - 40) / h) AS s FROM (SELECT p_partkey, w, h, CASE WHEN w > h THEN 841.89 ELSE 595.28 END AS pw, CASE WHEN w > h THEN 595.28 ELSE 841.89 END AS ph FROM (SELECT p_partkey, p_retailprice AS w, 1000.0 + p_size AS h FROM part)))",
)
def place_image(spark, d):
    at = P.placed(F.col("p_retailprice"), 1000.0 + F.col("p_size"), P.PAPER["a4"], 20.0)
    return read(spark, d, "part").select("p_partkey", *(r6(at[k]).alias(k) for k in ("scale", "x", "y")))


@query("placement_dpi", "SELECT p_partkey, (CASE WHEN p_size % 4 = 0 AND p_size > 0 THEN p_size * 10 WHEN p_size * 5 >= 100 THEN p_size * 5 ELSE 150 END)::DOUBLE AS dpi FROM part")
def placement(spark, d):
    return read(spark, d, "part").select("p_partkey", P.placement_dpi(F.when(F.col("p_size") % 4 == 0, F.col("p_size") * 10.0), F.col("p_size") * 5.0).alias("dpi"))


@query("round_half_up", "SELECT c_custkey, floor(c_acctbal / 3 + 0.5)::BIGINT AS rounded FROM customer")
def round_half_up(spark, d):
    return read(spark, d, "customer").select("c_custkey", P.half_up(F.col("c_acctbal") / 3).alias("rounded"))


@query("parallel_angles", "SELECT s_suppkey, least(m, 360 - m) <= 1 AS parallel FROM (SELECT s_suppkey, ((s_acctbal - s_suppkey * 7) % 360 + 360) % 360 AS m FROM supplier)")
def parallel_angles(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", P.parallel(F.col("s_acctbal"), F.col("s_suppkey") * 7.0).alias("parallel"))


@query("pdf_date", "SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || '+02''00''' AS written, o_orderdate - INTERVAL 2 HOUR AS signed_at FROM orders")
def pdf_date(spark, d):
    w = F.concat(F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss"), F.lit("+02'00'"))
    return read(spark, d, "orders").select("o_orderkey", w.alias("written"), P.pdf_date(w).cast("timestamp_ntz").alias("signed_at"))


@query("page_verdict", "SELECT o_orderkey, CASE WHEN n > 0 OR s < 0.85 THEN 'review' ELSE 'pass' END AS verdict FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, min(1 - l_discount * 2) AS s FROM lineitem GROUP BY 1)")
def page_verdict(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.min(1 - F.col("l_discount") * 2).alias("s"))
    return g.select("o_orderkey", P.text_verdict(F.col("n"), F.col("s")).alias("verdict"))


@query(
    "settlement_policy",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'changed' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'misread' WHEN l_tax * 10 >= 0.6 THEN 'changed'
  WHEN l_linestatus <> 'F' THEN 'unsettled' WHEN l_quantity < 10 THEN 'misread' WHEN l_quantity < 20 THEN 'changed' WHEN l_linenumber > 40 THEN 'unsettled' WHEN l_quantity >= 30 AND l_discount > 0.05 THEN 'misread' ELSE 'unsettled' END AS settled FROM lineitem""",
)
def settlement_policy(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    a = F.col("l_returnflag") == "A"
    c = {
        "print_check": F.when(a & (n == 1), "changed").when(a & (n == 2), "unchanged").otherwise("skipped"),
        "ink_mm2": F.col("l_tax") * 5,
        "kind": F.when(F.col("l_linestatus") == "F", "changed").otherwise("missing"),
        "glyph": F.when(q < 10, "confirmed").when(q < 20, "other").otherwise("none"),
        "order": n,
        "agreeing_passes": F.when(q >= 30, 2).otherwise(1),
        "sides_alike": F.col("l_discount") > 0.05,
    }
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.settlement(c).alias("settled"))


#: Line items as boxes on the page of their order.
_BOX = "l_orderkey AS page, l_linenumber AS box, l_quantity * 10 AS x, l_extendedprice % 700 AS y, 20 + l_tax * 500 AS w, 10 + l_discount * 200 AS h"


def _boxes(spark, d):
    return read(spark, d, "lineitem").selectExpr(*(x.strip() for x in _BOX.split(",")), "l_returnflag", "l_linestatus", "l_partkey")


def _as(df, prefix, name, *more):
    return df.select("page", F.col("box").alias(name), *(F.col(c).alias(f"{prefix}_{c}") for c in "xywh"), *more)


@query(
    "claim_words_spatial",
    f"""WITH b AS (SELECT {_BOX} FROM lineitem), c AS (SELECT w.page, w.box AS word, r.box AS run, r.w * r.h AS area, greatest(1.5, 0.3 * r.h) AS pad, w.x + w.w / 2 AS mx, w.y + w.h / 2 AS my, r.x, r.y, r.w AS rw, r.h AS rh
  FROM b w JOIN b r ON w.page = r.page) SELECT page, word, run FROM (SELECT *, row_number() OVER (PARTITION BY page, word ORDER BY area, run) AS k FROM c WHERE mx BETWEEN x - pad AND x + rw + pad AND my BETWEEN y - pad AND y + rh + pad) WHERE k = 1""",
)
def claim_words_spatial(spark, d):
    b = _boxes(spark, d)
    return B.claimed_words(_as(b, "w", "word"), _as(b, "r", "run"))


@query(
    "correlate_findings",
    f"""WITH b AS (SELECT {_BOX}, l_returnflag, l_linestatus FROM lineitem), j AS (SELECT f.page, f.box AS diff, CASE WHEN c.l_returnflag = 'R' THEN 0 ELSE 1 END AS phase, c.box AS ord FROM b f JOIN b c ON f.page = c.page AND f.l_linestatus = 'F' AND c.l_linestatus = 'O'
  AND f.x <= c.x + c.w + 1.5 AND c.x <= f.x + f.w + 1.5 AND f.y <= c.y + c.h + 1.5 AND c.y <= f.y + f.h + 1.5) SELECT page, diff, phase, ord FROM (SELECT *, row_number() OVER (PARTITION BY page, diff ORDER BY phase, ord) AS k FROM j) WHERE k = 1""",
)
def correlate_findings(spark, d):
    b = _boxes(spark, d)
    changes = _as(b.where("l_linestatus = 'O'"), "c", "ord", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("phase"))
    return B.first_claims(changes, _as(b.where("l_linestatus = 'F'"), "d", "diff"))


@query(
    "explain_findings",
    f"""WITH b AS (SELECT {_BOX}, l_returnflag, l_linestatus FROM lineitem), j AS (SELECT f.page, f.box AS diff, r.box AS region, f.l_returnflag = 'A' AS added, r.l_returnflag = 'N' AS identified, f.w * f.h AS area,
  greatest(0, least(f.x + f.w, r.x + r.w) - greatest(f.x, r.x)) * greatest(0, least(f.y + f.h, r.y + r.h) - greatest(f.y, r.y)) AS o FROM b f JOIN b r ON f.page = r.page)
SELECT page, diff, min(region) AS region FROM j WHERE CASE WHEN added THEN o >= 0.5 * area ELSE identified AND o > 0 END GROUP BY ALL""",
)
def explain_findings(spark, d):
    b = _boxes(spark, d)
    diffs = _as(b, "d", "diff", F.when(F.col("l_returnflag") == "A", "added").otherwise("changed").alias("kind"))
    regions = _as(b, "r", "region", (F.col("l_returnflag") == "N").alias("identified"))
    return B.explained(diffs, regions)


@query(
    "checkbox_groups",
    "SELECT o_orderkey AS grp, count(l_linenumber) AS read, CASE WHEN count(*) FILTER (l_orderkey IS NULL) > 0 THEN NULL WHEN bool_or(l_returnflag = 'R') THEN false ELSE count(*) FILTER (l_returnflag = 'A') = 1 END AS satisfied FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def checkbox_groups(spark, d):
    """Exactly one tick; a struck box fails the group; a missing one leaves it open."""
    j = read(spark, d, "orders").join(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    rule = F.when(F.count_if(F.col("l_linenumber").isNull()) > 0, F.lit(None).cast("boolean")).when(F.bool_or(F.col("l_returnflag") == "R"), F.lit(False)).otherwise(F.count_if(F.col("l_returnflag") == "A") == 1)
    return j.groupBy(F.col("o_orderkey").alias("grp")).agg(F.count("l_linenumber").alias("read"), rule.alias("satisfied"))


@query("top_changes", f"SELECT page, box, rank, truncated FROM (SELECT page, box, (row_number() OVER (PARTITION BY page ORDER BY w * h DESC, box))::INTEGER AS rank, count(*) OVER (PARTITION BY page) > 2 AS truncated FROM (SELECT {_BOX} FROM lineitem)) WHERE rank <= 2")
def top_changes(spark, d):
    return B.top_per_page(_boxes(spark, d).withColumn("pixels", F.col("w") * F.col("h")).withColumn("ord", F.col("box")), 2).select("page", "box", "rank", "truncated")


@query(
    "spatial_top_n",
    "SELECT page, point, rank FROM (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY first DESC, score DESC, point))::INTEGER AS rank FROM (SELECT *, (row_number() OVER (PARTITION BY page, cell ORDER BY score DESC, point) <= 2)::INTEGER AS first FROM (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS point, l_partkey % 64 AS cell, l_extendedprice AS score FROM lineitem))) WHERE rank <= 128",
)
def spatial_top_n(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"), (F.col("l_partkey") % 64).alias("cell"), F.col("l_extendedprice").alias("score"))
    return B.spread_top(p, 128).select("page", "point", "rank")


@query("gaps_islands_runs", "SELECT l_suppkey, min(day) AS first, max(day) AS last, count(*) AS length FROM (SELECT l_suppkey, day, day - row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS g FROM (SELECT DISTINCT l_suppkey, datediff('day', DATE '1970-01-01', l_shipdate::DATE)::INTEGER AS day FROM lineitem)) GROUP BY l_suppkey, g")
def gaps_islands_runs(spark, d):
    return B.islands(read(spark, d, "lineitem").select("l_suppkey", F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day")), ["l_suppkey"], "day")


@query("cumulative_trims", "WITH h AS (SELECT floor(l_extendedprice / 1000)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) SELECT min(bin) FILTER (upto > total * 0.004) AS first, min(bin) FILTER (upto >= total * 0.996) AS last FROM c")
def cumulative_trims(spark, d):
    li = read(spark, d, "lineitem").withColumn("img", F.lit(0))
    return M.trims(M.histogram(li, ["img"], F.floor(F.col("l_extendedprice") / 1000)), ["img"]).drop("img")


_OTSU = """WITH h AS (SELECT l_returnflag AS img, least(255, floor(l_quantity * 5 + 0.5))::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT img, bin, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY img) AS n1, sum(n * bin) OVER (PARTITION BY img) AS s1 FROM h WINDOW w AS (PARTITION BY img ORDER BY bin)),
v AS (SELECT img, bin, n0::DOUBLE * (n1 - n0) * (s0::DOUBLE / n0 - (s1 - s0)::DOUBLE / (n1 - n0)) ** 2 AS var FROM c WHERE n1 > n0)"""


@query("otsu_threshold", _OTSU + " SELECT img, bin FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(var, 3) DESC, bin) AS k FROM v) WHERE k = 1")
def otsu_threshold(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "img")
    return M.otsu(M.histogram(li, ["img"], F.least(F.lit(255), F.floor(F.col("l_quantity") * 5 + 0.5))), ["img"])


@query("contrast_points", "WITH h AS (SELECT l_suppkey AS img, least(255, floor(l_extendedprice / 100000 * 255))::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT img, bin, sum(n) OVER (PARTITION BY img ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY img) AS total FROM h) SELECT img, round(greatest(0.0, least(0.4, min(bin) FILTER (upto >= total * 0.01) / 170.0)), 6) AS black, round(greatest(0.7, least(1.1, min(bin) FILTER (upto >= total * 0.99) / 170.0)), 6) AS white FROM c GROUP BY img")
def contrast_points(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "img")
    got = M.contrast_points(M.histogram(li, ["img"], F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 100000 * 255))), ["img"], 1 / 170.0)
    return got.select("img", r6(F.col("black")).alias("black"), r6(F.col("white")).alias("white"))


@query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(count(*) FILTER (l_quantity > 25 AND l_tax > 0.04)::DOUBLE / count(*) FILTER (l_quantity > 25 OR l_tax > 0.04), 6) AS iou FROM lineitem GROUP BY 1")
def correlation(spark, d):
    a, b = F.col("l_quantity") > 25, F.col("l_tax") > 0.04
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("correlation"), r6(F.count_if(a & b) / F.count_if(a | b)).alias("iou"))


@query("matrix_apply", "SELECT l_orderkey, l_linenumber, round((1.01 * x - 0.02 * y + 5) / (0.0001 * x + 0.0002 * y + 1), 6) AS x, round((0.02 * x + 0.99 * y - 3) / (0.0001 * x + 0.0002 * y + 1), 6) AS y FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice % 700 AS y FROM lineitem)")
def matrix_apply(spark, d):
    x, y = F.col("l_quantity"), F.col("l_extendedprice") % 700
    w = 0.0001 * x + 0.0002 * y + 1
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6((1.01 * x - 0.02 * y + 5) / w).alias("x"), r6((0.02 * x + 0.99 * y - 3) / w).alias("y"))


_FIT = "(SELECT l_suppkey AS page, l_quantity AS x, l_tax * 500 AS y, 1.02 * l_quantity - 0.03 * (l_tax * 500) + l_discount AS u, 0.03 * l_quantity + 1.02 * (l_tax * 500) - l_discount AS v FROM lineitem)"


@query("fit_similarity", f"SELECT page, round((covar_pop(x, u) + covar_pop(y, v)) / (var_pop(x) + var_pop(y)), 6) AS a, round((covar_pop(x, v) - covar_pop(y, u)) / (var_pop(x) + var_pop(y)), 6) AS b FROM {_FIT} GROUP BY page HAVING count(*) > 2")
def fit_similarity(spark, d):
    """Least squares of rotation, scale and shift by sums alone: mergeable, so pages of any size are pre-aggregated."""
    q, t, s = F.col("l_quantity"), F.col("l_tax") * 500, F.col("l_discount")
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), q.alias("x"), t.alias("y"), (1.02 * q - 0.03 * t + s).alias("u"), (0.03 * q + 1.02 * t - s).alias("v"))
    spread = F.var_pop("x") + F.var_pop("y")
    g = p.groupBy("page").agg(F.count("*").alias("n"), r6((F.covar_pop("x", "u") + F.covar_pop("y", "v")) / spread).alias("a"), r6((F.covar_pop("x", "v") - F.covar_pop("y", "u")) / spread).alias("b"))
    return g.where("n > 2").drop("n")


@query("merge_boxes")
def merge_boxes(spark, d):
    return B.merged(_boxes(spark, d).withColumn("pixels", F.col("l_partkey")).select("page", "box", "x", "y", "w", "h", "pixels"), 30.0)


@query("reading_order")
def reading_order(spark, d):
    return B.reading_order(_boxes(spark, d).select("page", F.col("box").alias("word"), "x", "y", "h"))
