"""Findings, words, fields, pages and numbers against plain computations on made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import numbers
from folioscope.operators import fields, findings, measures, pages, words

SLACK = findings.SLACK


def boxes(r, n, size=60):
    return [(r.uniform(0, 260), r.uniform(0, 260), r.uniform(1, size), r.uniform(1, size)) for _ in range(n)]


def near(a, b):
    return a[0] < b[0] + b[2] + SLACK and a[0] + a[2] + SLACK > b[0] and a[1] < b[1] + b[3] + SLACK and a[1] + a[3] + SLACK > b[1]


def part(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3]) if w > 0 and h > 0 else 0


def test_correlation_of_a_page(spark):
    r = random.Random(3)
    for page in range(6):
        kinds = ["added", "changed", "missing"]
        diffs = [(page, i, r.choice(kinds), f"p{i}", f"f{i}", r.choice(["text", "numbers"]), *b) for i, b in enumerate(boxes(r, 14))]
        changes = [(page, side, i, r.uniform(0, 9), *b) for side in ("unexpected", "missing") for i, b in enumerate(boxes(r, 5))]
        regions = [(page, i, f"r{i}", r.random() < 0.5, r.random() < 0.5, *b) for i, b in enumerate(boxes(r, 4, 90))]
        settled = [(page, i, r.choice(["misread", "unsettled", "changed"]), r.random() < 0.5) for i in range(0, 14, 2)]
        ticks = [(page, i, f"r{i}", r.choice(["empty", "ticked", "struck"]), r.choice(["empty", "ticked"]), "ticked", r.choice([True, False, None]), *b) for i, b in enumerate(boxes(r, 2))]
        table = lambda rows, names: spark.createDataFrame(rows, names)
        box = lambda p: ", ".join(f"{p}_{c} double" for c in "xywh")
        got = findings.correlated(
            table(diffs, f"page int, diff int, kind string, expected string, found string, reason string, {box('d')}"),
            table(changes, f"page int, side string, change int, ink_mm2 double, {box('c')}"),
            table(regions, f"page int, region int, region_id string, identified boolean, overfilled boolean, {box('r')}"),
            table(settled, "page int, diff int, verdict string, steady boolean"),
            table(ticks, f"page int, ord int, id string, state string, before string, expect string, satisfied boolean, {box('b')}"),
            ["page"],
        )
        got = [(x.kind, x.corroborated, x.summary, round(x.x, 6)) for x in got.orderBy("position").collect()]
        open_ = [d for d in diffs if not any((part(d[6:], g[5:]) >= 0.5) if d[2] == "added" else (g[3] and near(d[6:], g[5:])) for g in regions)]
        want, used = [], set()
        for side, kind, may in (("unexpected", "unexpected-mark", ("added", "changed")), ("missing", "missing-ink", ("missing", "changed"))):
            for c in [c for c in changes if c[1] == side]:
                hit = [d for d in open_ if d[1] not in used and d[2] in may and near(d[6:], c[4:])]
                used |= {d[1] for d in hit}
                said = " ".join(d[4] if side == "unexpected" else d[3] for d in hit)
                text = (f'Ink added where nothing was expected, reading "{said}"' if side == "unexpected" else f'Printed ink lost, and with it "{said}"') if hit else f"{'Ink added where nothing was expected' if side == 'unexpected' else 'Printed ink lost'} ({c[3]:.1f} mm2)"
                want.append((kind, bool(hit), text, round(c[4], 6)))
        verdicts = {s[1]: s for s in settled}
        for d in open_:
            v = verdicts.get(d[1], (0, 0, None, False))
            if d[1] in used or v[2] == "misread":
                continue
            said = f'Printed "{d[3]}" reads "{d[4]}"' + (" - its figures differ" if d[5] == "numbers" else "") if d[2] == "changed" else f'Printed "{d[3]}" could not be read' if d[2] == "missing" else f'Words the original does not have: "{d[4]}"'
            if v[2] == "unsettled":
                said += " - the ink is identical and re-reading could not settle it" + (", though each side read the same thing every time" if v[3] else "")
            want.append(("text-unsettled" if v[2] == "unsettled" else f"text-{d[2]}", False, said, round(d[6], 6)))
        ids = {t[2] for t in ticks}
        want += [("expected-overfilled" if g[4] else "expected-empty", False, f'"{g[2]}" ' + ("is covered, not filled in" if g[4] else "was left empty"), round(g[5], 6)) for g in regions if not g[3] and g[2] not in ids]
        for t in ticks:
            if t[6] is False:
                want.append(("checkbox-mismatch", False, f'"{t[2]}" must be ticked, and is {t[3]}', round(t[7], 6)))
            elif t[3] == "struck":
                want.append(("checkbox-struck", False, f'"{t[2]}" is inked over: whether it is ticked cannot be told', round(t[7], 6)))
            elif t[4] != "empty" and t[3] == "empty":
                want.append(("checkbox-cleared", False, f'"{t[2]}" was ticked on the original and is empty on the scan', round(t[7], 6)))
        assert got == want, page


def test_readings_and_judgements(spark):
    runs = [(1, 1, "Total due", 10.0, 10.0, 100.0, 10.0), (1, 2, "1,250.00", 10.0, 40.0, 60.0, 10.0), (1, 3, "Signed", 10.0, 70.0, 60.0, 10.0), (1, 4, "12/05", 200.0, 10.0, 40.0, 10.0), (1, 5, "~", 200.0, 70.0, 40.0, 10.0)]
    read = [(1, 1, 0, "due", 90.0, 60.0, 11.0, 20.0, 9.0), (1, 2, 0, "Tota1", 90.0, 12.0, 13.0, 30.0, 9.0), (1, 3, 1, "7,250.00", 90.0, 12.0, 41.0, 40.0, 9.0), (1, 4, 2, "forged", 90.0, 300.0, 200.0, 30.0, 9.0), (1, 5, 2, "here", 61.0, 340.0, 200.0, 20.0, 9.0), (1, 6, 3, "speck", 59.0, 300.0, 300.0, 20.0, 9.0), (1, 7, 3, "tiny", 99.0, 300.0, 320.0, 20.0, 3.0), (1, 8, 3, "__", 99.0, 300.0, 340.0, 20.0, 9.0), (1, 9, 0, "12 05.", 90.0, 205.0, 11.0, 30.0, 9.0)]
    box = lambda p: ", ".join(f"{p}_{c} double" for c in "xywh")
    got = words.matched(spark.createDataFrame(read, f"page int, word long, line int, text string, confidence double, {box('w')}"), spark.createDataFrame(runs, f"page int, run int, text string, {box('r')}"), ["page"]).orderBy("ord").collect()
    # 'Tota1' adds a digit that was never printed.
    assert [(x.kind, x.expected, x.found, x.reason) for x in got] == [("changed", "Total due", "Tota1 due", "numbers"), ("changed", "1,250.00", "7,250.00", "numbers"), ("missing", "Signed", None, "text"), ("added", None, "forged here", "text")]
    assert (got[3].x, got[3].w) == (300.0, 60.0) and got[2].similarity == 0.0


@pytest.mark.parametrize("read,printed,cells,want", [("l,25O", "1,250", [(0, "1", "1"), (4, "0", "0")], "1,250"), ("l,2", "1,250", [(0, "1", "7")], "print"), ("l,2", "1,250", [(0, "1", "1")], "l,2"), (" ", "1,250", [(0, "1", "1")], "print"), ("1 2", "12", [(1, "2", "3")], "1 3"), ("1", "1", [(0, "1", None)], "1")])
def test_verified_figures(spark, read, printed, cells, want):
    df = spark.createDataFrame([(read, printed, cells, "print")], "r string, p string, c array<struct<at:int,printed:string,read:string>>, v string")
    assert df.select(words.merged_reading(F.col("r"), F.col("p"), F.col("c"), F.col("v")).alias("m")).first().m == want


def run(text, x, y, width=None, height=10.0, angle=0.0):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width or 6 * len(text)), "height": height, "angle": angle}


def test_places_of_labels():
    page = [run("Signature of", 20, 100), run("the customer:", 110, 101), run("Name", 20, 200), run("of the", 20, 214), run("Customer", 20, 228), run("Date: name of the", 300, 50), run("customer", 300, 300)]
    at = lambda *a: [(p["x"], p["y"], p["estimated"]) for p in fields.places_of(*a)]
    assert at(page, "Signature of the Customer") == [(20.0, 100.0, False)]
    assert at(page, "NAME of the customer") == [(20.0, 200.0, False)]
    assert at(page, "date") == [(300.0, 50.0, True)] and fields.places_of(page, "date")[0]["w"] == pytest.approx(30.0)
    assert at(page, "customer") == [(110.0 + 13 * 6 * 4 / 13, 101.0, True), (20.0, 228.0, False), (300.0, 300.0, False)]
    assert at(page, "") == [] and at(page, "nothing") == [] and at([], "x") == []
    # Too far on the line, or turned another way.
    assert at([run("Pay", 20, 10), run("now", 100, 10)], "pay now") == []
    assert at([run("Pay", 20, 10), run("now", 40, 10, angle=90.0)], "pay now") == []
    turned = fields.places_of([run("Pay now", 20, 10, 10, 42.0, 90.0)], "pay now")
    assert (turned[0]["w"], turned[0]["h"]) == (10.0, 42.0)


def test_fields_and_their_problems(spark):
    runs = "array<struct<text:string,x:double,y:double,width:double,height:double,angle:double>>"
    pgs = spark.createDataFrame([("d", 1, 200.0, 200.0, [run("Name", 10, 10), run("Sign", 10, 50)]), ("d", 2, 200.0, 200.0, [run("Sign", 10, 20), run("Date", 150, 190)]), ("e", 1, 200.0, 200.0, [])], f"doc string, page long, width double, height double, runs {runs}")
    f = lambda i, dx, dy, w=20.0, h=10.0: (i, dx, dy, w, h)
    specs = [("d", 0, "name", None, None, "top-right", [f("n", 5.0, 0.0), f("m", 10.0, 2.0)]), ("d", 1, "sign", None, None, "top-left", [f("x", 0.0, 0.0)]), ("d", 2, "sign", 2, None, "bottom-left", [f("s", 0.0, 3.0), f("n", 0.0, 0.0)]), ("d", 3, "sign", None, 3, "top-left", [f("y", 0.0, 0.0)]), ("d", 4, "nowhere", None, None, "top-left", [f("z", 0.0, 0.0)]), ("d", 5, "date", None, None, "top-left", [f("d", 0.0, 0.0, 90.0), f("g", 0.0, 0.0, 0.0)]), ("e", 0, "name", None, None, "top-left", [f("n", 0.0, 0.0)])]
    spec = spark.createDataFrame(specs, "doc string, spec int, anchor string, page long, occurrence long, corner string, fields array<struct<id:string,dx:double,dy:double,width:double,height:double>>")
    regions, problems = fields.resolved(pgs, spec)
    assert {(r.doc, r.id, r.page, r.x, r.y) for r in regions.collect()} == {("d", "n", 1, 39.0, 10.0), ("d", "m", 1, 44.0, 12.0), ("d", "s", 2, 10.0, 33.0), ("d", "d", 2, 150.0, 190.0), ("d", "g", 2, 150.0, 190.0)}
    assert {(p.doc, p.kind, p.id, p.other) for p in problems.collect()} == {("d", "anchor-ambiguous", "sign", None), ("d", "occurrence-missing", "sign", None), ("d", "anchor-missing", "nowhere", None), ("d", "duplicate-id", "n", None), ("d", "off-page", "d", None), ("d", "not-finite", "g", None), ("d", "overlap", "n", "m"), ("e", "anchor-missing", "name", None)}


def test_pages(spark):
    rows = spark.createDataFrame([(d, p) for d, n in (("a", 1), ("b", 3), ("c", 8), ("d", 9)) for p in range(1, n + 1)], "doc string, page int")
    kept = {}
    for r in pages.sample_spread(rows, ["doc"], "page").collect():
        kept.setdefault(r.doc, []).append(r.page)
    assert {d: sorted(p) for d, p in kept.items()} == {"a": [1], "b": [1, 2, 3], "c": [1, 5, 8], "d": [1, 5, 9]}
    got = {(r.doc, r.page): (r.batch, r.batches) for r in pages.batches(rows, ["doc"], "page").collect()}
    assert got["d", 4] == (1, 3) and got["d", 5] == (2, 3) and got["d", 9] == (3, 3) and got["a", 1] == (1, 1)
    with pytest.raises(ValueError):
        pages.batches(rows, ["doc"], "page", 0)
    with pytest.raises(Exception, match="quarter"):
        rows.select(pages.viewport(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(45))).collect()


NUMBERS = [("", 0.0), ("  \n", 0.0), ("12", 12.0), ("-1.5e3", -1500.0), (".5", 0.5), ("5.", 5.0), ("+7", 7.0), ("0x1F", 31.0), ("0XfF", 255.0), ("0o17", 15.0), ("0b101", 5.0), ("Infinity", math.inf), ("-Infinity", -math.inf), ("0x", None), ("0x+1", None), ("0b2", None), ("1_0", None), ("inf", None), ("NaN", None), ("1 2", None), (".", None), ("-0x1", None), ("0x" + "f" * 20, float(int("f" * 20, 16)))]


def test_numbers(spark):
    got = spark.createDataFrame([(t,) for t, _ in NUMBERS], "t string").select("t", numbers.text_number(F.col("t")).alias("n")).collect()
    for r, (t, want) in zip(got, NUMBERS, strict=True):
        plain = numbers.written_number(t)
        assert (math.isnan(r.n) and math.isnan(plain)) if want is None else math.isclose(r.n, want, rel_tol=1e-15) and plain == want, t
    cases = [(0.0, 0), (1.9, 1), (-1.9, -1), (2147483648.0, -2147483648), (-2147483649.0, 2147483647), (4294967297.0, 1), (1e20, 1661992960), (math.inf, 0), (math.nan, 0)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "x double").select(numbers.int32(F.col("x")).alias("i"), numbers.uint32(F.col("x")).alias("u")).collect()
    assert [(r.i, r.u) for r in got] == [(i, i % 2**32) for _, i in cases]
    pairs = [(a, b) for a in (0, 1, -1, 65535, 65536, 2147483647, -2147483648, 123456789) for b in (1, -1, 48271, -2147483648, 987654321)]
    got = spark.createDataFrame(pairs, "a int, b int").select(numbers.multiply32(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in got] == [(a * b + 2**31) % 2**32 - 2**31 for a, b in pairs]
    dates = [(1970, 0, 1, 0), (70, 0, 1, 0), (2024, 1, 30, 1709251200000), (2000, 13, 1, 980985600000), (1969, -1, 31, -31622400000), (400000, 0, 1, None)]
    got = spark.createDataFrame([d[:3] for d in dates], "y int, m int, d int").select(numbers.date_utc(F.col("y"), F.col("m"), F.col("d"), F.lit(0), F.lit(0), F.lit(0)).alias("ms")).collect()
    assert [r.ms for r in got] == [d[3] for d in dates]


def test_regions_without_a_page_are_on_every_page(spark):
    pgs = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "doc string, page int")
    regions = spark.createDataFrame([("d", 2, "own"), ("d", None, "all"), ("e", 9, "none")], "doc string, page int, id string")
    assert {tuple(r) for r in findings.regions_of(pgs, regions, ["doc"]).collect()} == {("d", 2, "own"), ("d", 1, "all"), ("d", 2, "all")}


def test_explicit_pairs(spark):
    a = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc string, page int")
    b = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    both, left = measures.paired(a, b, ["doc"])
    assert {tuple(r) for r in both.collect()} == {("d", 1, 1), ("d", 2, 2)} and [tuple(r) for r in left.collect()] == [("d", "issued", 3, None)]
    both, left = measures.paired(a, b, ["doc"], spark.createDataFrame([("d", 3, 1), ("d", 3, 2), ("d", 7, 2)], "doc string, issued int, returned int"))
    assert [tuple(r) for r in both.collect()] == [("d", 3, 1)]
    assert {tuple(r) for r in left.collect()} == {("d", "issued", 1, None), ("d", "issued", 2, None), ("d", "returned", 2, None), ("d", "pair", 3, "paired twice"), ("d", "pair", 7, "no such issued page")}
