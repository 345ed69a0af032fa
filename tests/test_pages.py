"""Rasters, geometry, sources, streams and the session on made inputs."""

import numpy as np
import pytest

from folioscope.functions import geometry as G
from folioscope.functions import raster as R
from folioscope.operators import boxes as B
from folioscope.operators import calibrate as C
from folioscope.sources import pdf, synthetic


def test_generator_is_the_published_one():
    r = G.Mulberry(0)
    assert [round(r.uniform(), 10) for _ in range(2)] == [0.2664292087, 0.0003297457]


def test_fits_are_exact_on_exact_points():
    r = np.random.RandomState(1)
    p = r.rand(12, 2) * 500
    for model, m in (("similarity", [[0.9, -0.2, 7], [0.2, 0.9, -4], [0, 0, 1]]), ("affine", [[1.1, 0.1, 3], [-0.2, 0.8, 9], [0, 0, 1]]), ("homography", [[1, 0.1, 3], [0.05, 1.1, 2], [1e-4, -2e-4, 1]])):
        m = np.array(m)
        assert np.allclose(G.MODELS[model][1](p, G.apply(m, p)), m, atol=1e-6)
        assert np.allclose(G.apply(G.invert(m), G.apply(m, p)), p)
    assert G.fit_similarity(p[:1], p[:1]) is None and G.fit_affine(np.zeros((5, 2)), p[:5]) is None and G.invert(np.zeros((3, 3))) is None
    assert not G.plausible(np.diag([-1.0, 1, 1])) and not G.plausible(np.diag([9.0, 1, 1])) and G.plausible(np.eye(3))


def test_components_and_morphology():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert [c["pixels"] for c in R.components(m)] == [2, 2, 2, 1]
    assert [c["pixels"] for c in R.components(m, diagonal=False)] == [1, 2, 1, 2, 1]
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert R.components(u) == [{"x": 0, "y": 0, "w": 3, "h": 3, "pixels": 7}]
    one = np.zeros((7, 7), bool)
    one[3, 3] = True
    assert R.dilate(one, 2).sum() == 25 and (R.erode(R.dilate(one, 2), 2) == one).all()
    assert R.components(np.zeros((3, 3), bool)) == []


def test_levels_and_measures():
    flat = np.full((40, 40), 0.7, np.float32)
    assert R.ink_map(flat).max() == 0 and R.noise_sigma(flat) < 1e-9 and R.correlation(np.ones((4, 4)), flat[:4, :4]) == 0 and R.iou(flat > 1, flat > 1) == 0
    assert R.otsu(np.r_[np.zeros(50), np.ones(50)]) == 0.0
    speck = flat.copy()
    speck[5, 5] = 0
    assert (R.despeckle(speck) == flat).all()
    white = np.dstack([np.full((2, 2), v, np.uint8) for v in (0, 0, 0, 0)])
    assert (R.to_gray(white) == 1).all()


def test_scan_is_found_again():
    page = synthetic.form(3)
    scan, m = synthetic.scanned(page, 1, 0.0, 1.0, (6.0, -4.0))
    dx, dy, _ = R.phase_correlate(page, scan)
    assert abs(dx - 6) < 0.5 and abs(dy + 4) < 0.5
    turned, m = synthetic.scanned(page, 1, 3.0)
    assert R.correlation(page, R.warp(turned, m, page.shape)) > 0.9 > R.correlation(page, turned)
    assert abs(abs(R.estimate_skew(R.binarize(R.ink_map(turned)))) - 3) < 0.3
    marked = page.copy()
    marked[500:506, 200:300] = 0.1
    d = R.diff_page(page, marked)
    assert len(d["unexpected"]) == 1 and not d["missing"] and not R.diff_page(page, page)["unexpected"]
    assert len(R.diff_page(marked, page)["missing"]) == 1


def test_checkbox():
    box = np.zeros((40, 40), bool)
    assert R.checkbox_state(box, 150) == "empty"
    box[18:22, 10:30] = True
    assert R.checkbox_state(box, 150) == "ticked"
    box[8:32, 8:32] = True
    assert R.checkbox_state(box, 150) == "struck"


def test_signatures(spark):
    head = b"%%PDF-1.7 1 0 obj << /Type /Sig /Name (A\\)nn) /ByteRange [0 %d %d %d] /Contents <"
    tail = b"> >> endobj"
    first = len(head)
    for _ in range(3):
        body = head % (first, first + 6, len(tail) - 1)
        first = len(body) - 1
    body = head % (first, first + 6, len(tail) - 1)
    good = body + b"00ff" + tail
    (s,) = pdf.signatures(good)
    assert s["name"] == "A)nn" and s["contents"] == b"\x00\xff" and s["covers_file"]
    rows = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good + b" more")), ("c", bytearray(b"%PDF")), ("d", None)], "path string, content binary")
    got = {r.path: (r.signed, r.unbroken, r.n_signatures) for r in pdf.checked_seals(rows).collect()}
    assert got == {"a": (True, True, 1), "b": (True, False, 1), "c": (False, False, 0), "d": (False, False, 0)}
    assert not pdf.checked_seals(rows, lambda covered, signature: False).where("unbroken").count()
    kinds = rows.select(pdf.is_pdf("content").alias("x"), pdf.is_pdf_to_merge("content").alias("y")).collect()
    assert [(r.x, r.y) for r in kinds] == [(True, True), (True, True), (False, False), (False, False)]


def test_synthetic_source(spark):
    spark.dataSource.register(synthetic.PageSource)
    rows = spark.read.format("synthetic_pages").option("pages", 3).load().collect()
    assert sorted(r.page for r in rows) == [0, 1, 2] and all(len(r.scan) == r.width * r.height and len(r.matrix) == 9 for r in rows)


def test_boxes(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 5), (1, 2, 12.0, 0.0, 5.0, 10.0, 3), (1, 3, 100.0, 0.0, 5.0, 5.0, 1), (2, 1, 0.0, 0.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "page long, box long, x double, y double, w double, h double, pixels long")
    assert sorted((r.page, r.w, r.pixels, r.parts) for r in B.merged(df, 2.0).collect()) == [(1, 5.0, 1, 1), (1, 17.0, 8, 2), (2, 1.0, 1, 1)]
    words = df.selectExpr("page", "box as word", "x", "y", "h")
    assert sorted(map(tuple, B.reading_order(words).where("page = 1").collect())) == [(1, 1, 0, 0), (1, 2, 0, 1), (1, 3, 0, 2)]
    assert B.merged(df.limit(0), 2.0).count() == 0


def test_calibration(spark):
    pages = spark.createDataFrame([(1, 0.99, None, None, False), (2, 0.7, None, None, False), (3, 0.99, 5.0, None, False), (4, 0.99, None, None, True)], "sample long, text_score double, worst_change double, worst_missing double, always boolean")
    samples = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, True)], "sample long, genuine boolean")
    got = {r.point: r for r in C.ranked(C.sweep(pages, samples, C.grid(spark, (0.6, 0.8), (4.0, 8.0), (4.0,)))).collect()}
    assert {k: (r.false_accepts, r.false_reviews) for k, r in got.items()} == {0: (1, 1), 1: (2, 1), 2: (0, 1), 3: (1, 1)}
    assert [k for k, r in got.items() if r.best] == [2] and round(got[2].accept_upper, 4) == 0.6576


def test_arriving_files(spark, tmp_path):
    from folioscope.streaming import ingest

    there = tmp_path / "in"
    there.mkdir()
    for n, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (there / n).write_text(text)
    go = lambda: ingest.audited(ingest.arriving(spark, str(there)), lambda b: b.select("digest", "length"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (there / "d").write_text("three")
    go()
    assert spark.read.parquet(str(tmp_path / "out")).select("digest").distinct().count() == 3


def test_session(spark):
    from folioscope.session import Comparison, fingerprint

    a = spark.createDataFrame([(1, 1, "Total 12.50", "x"), (1, 2, "same", "y"), (2, 1, "", "z"), (3, 1, "gone", "z")], "doc_id long, page int, text string, mine string")
    b = spark.createDataFrame([(1, 1, "Totals 99.99"), (1, 2, "SAME"), (2, 1, ""), (4, 1, "new")], "doc_id long, page int, text string")
    c = Comparison(a, b)
    got = {r.doc_id: (r.verdict, r.review_pages) for r in c.audit().collect()}
    assert got == {1: ("review", 1), 2: ("pass", 0)} and "mine" in c.text().columns and c.text() is c.text()
    assert sorted((r.doc_id, r.side) for r in c.unpaired().collect()) == [(3, "issued"), (4, "returned")]
    c.stages.drop("pages")
    assert not c.stages.kept
    assert fingerprint(a=1, b=None) == fingerprint(a=1) != fingerprint(a=2)


def test_page_that_differs_in_size():
    with pytest.raises(ValueError):
        R.diff_page(np.ones((3, 3)), np.ones((4, 3)))
