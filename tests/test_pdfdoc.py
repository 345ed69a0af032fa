"""PDF documents: what is written is read, whole or merged, and broken ones are told."""

import zlib

import numpy as np
import pytest

from folioscope.sources import pdfdoc as P

PAGE = {"width": 612, "height": 792, "texts": [("Total due: 1,250.00", 72, 100, 12, True), ("Ünïcode € (paren) \\ end", 72, 130, 10, True), ("   ", 10, 10, 10, True), ("hidden", 72, 700, 8, False)], "lines": [(72, 110, 300, 110, 1)]}


def test_round_trip():
    scan = np.random.RandomState(1).randint(0, 256, (330, 255)).astype(np.uint8)
    data = P.created([PAGE, PAGE | {"rotation": 90}, {"width": 612, "height": 792, "images": [(scan, 0, 0, 612, 792)]}, {"width": 100, "height": 50}], {"Title": "Ein Títel"})
    doc = P.Document(data)
    assert doc.info() == {"Title": "Ein Títel"} and [doc.size(p) for p in doc.pages] == [(612, 792, 0), (792, 612, 90), (612, 792, 0), (100, 50, 0)]
    one, two, three, four = P.pages_of(data)
    assert [r["text"] for r in one[12]] == ["Total due: 1,250.00", "Ünïcode € (paren) \\ end", "hidden"] and one[11].count("\n") == 3
    first = one[12][0]
    assert (first["x"], first["angle"], first["size"]) == (72, 0, 12) and first["y"] == pytest.approx(100 - 0.8 * 12) and first["height"] == pytest.approx(12) and first["width"] == pytest.approx(P.text_width("Total due: 1,250.00", 12))
    assert (one[10], three[10], four[10]) == ("vector", "scanned", "empty")
    turned = two[12][0]
    assert turned["angle"] == pytest.approx(90) and turned["height"] == pytest.approx(first["width"]) and turned["x"] == pytest.approx(792 - 100 - 0.2 * 12) and turned["y"] == pytest.approx(72)
    assert three[7] == 1.0 and three[9] == pytest.approx(30, abs=0.01) and one[9] is None


def test_merge_and_selection():
    a, b = P.created([PAGE, {"width": 10, "height": 20}]), P.created([{"width": 30, "height": 40, "texts": [("b", 1, 10, 5, True)]}])
    both = P.Document(P.merged([a, b]))
    assert [both.size(p)[:2] for p in both.pages] == [(612, 792), (10, 20), (30, 40)]
    some = P.merged([a, b, a], [[2], None, [2, 1]])
    assert [r[2:4] for r in P.pages_of(some)] == [(10, 20), (30, 40), (10, 20), (612, 792)]
    assert [[x["text"] for x in r[12]][:1] for r in P.pages_of(some)] == [[], ["b"], [], ["Total due: 1,250.00"]]
    with pytest.raises(ValueError):
        P.merged([a], [[3]])
    with pytest.raises(ValueError):
        P.merged([])


def test_operators_maps_and_forms():
    cmap = P.Stream({}, b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange")
    form = P.Stream({"Subtype": P.Name("Form"), "Matrix": [1, 0, 0, 1, 10, 0]}, b"BT /W 10 Tf 5 700 Td <00010002> Tj ET")
    body = b"q 2 0 0 2 0 0 cm BT /S 10 Tf 12 TL 20 300 Td (a\\(b\\)\\101) Tj T* [(x) -500 (y)] TJ (next) ' ET Q /X Do BI /W 1 ID \x00\xffEI EI\n0 0 5 5 re f %comment\n1 2 bad"
    objects = [{"Type": P.Name("Catalog"), "Pages": P.Ref(2)}, {"Kids": [P.Ref(3)], "MediaBox": [0, 0, 600, 800]}, {"Type": P.Name("Page"), "Contents": [P.Ref(4)], "Resources": {"Font": {"S": {"Widths": [1000] * 300, "FirstChar": 0}, "W": P.Ref(5)}, "XObject": {"X": P.Ref(6)}}}, P.Stream({}, body), {"Subtype": P.Name("Type0"), "ToUnicode": P.Ref(7), "DescendantFonts": [{"DW": 500, "W": [1, [700], 2, 4, 900]}]}, form, cmap]
    (page,) = P.pages_of(P.assembled(objects, 1))
    runs = page[12]
    assert [r["text"] for r in runs] == ["a(b)A", "xy", "next", "Ab"] and page[8] is True
    assert runs[0]["x"] == 40 and runs[0]["width"] == pytest.approx(100) and runs[0]["size"] == 20
    assert runs[1]["y"] - runs[0]["y"] == pytest.approx(24) and runs[1]["width"] == pytest.approx(50)
    assert runs[3]["x"] == pytest.approx(15) and runs[3]["width"] == pytest.approx(16)


def test_object_streams_and_updates():
    inner = b"1 0 2 31 " + b"<</Type /Catalog /Pages 2 0 R>>" + b"<</Kids [3 0 R] /Count 1>>"
    raw = zlib.compress(inner)
    data = b"%PDF-1.5\n3 0 obj <</Type /Page /MediaBox [0 0 9 9]>> endobj\n9 0 obj <</Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length " + str(len(raw)).encode() + b">> stream\n" + raw + b"\nendstream endobj\n8 0 obj <</Type /XRef /Root 1 0 R>> stream\n\nendstream endobj\n3 0 obj <</Type /Page /MediaBox [0 0 7 5]>> endobj"
    assert [P.Document(data).size(p)[:2] for p in P.Document(data).pages] == [(7, 5)]


def test_broken_documents(spark):
    good = P.created([PAGE])
    rows = [("good", bytearray(good)), ("no", bytearray(b"hello")), ("none", None), ("cut", bytearray(good[:200])), ("locked", bytearray(good.replace(b"/Size", b"/Encrypt 1 0 R /Size")))]
    got = {r.path: r for r in P.read_pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["good"].problem is None and got["good"].characters == 17 + 19 + 6
    assert {k: r.problem for k, r in got.items() if k in ("no", "none", "locked")} == {"no": "not a PDF", "none": "not a PDF", "locked": "the document is encrypted"}
    assert len(got) in (4, 5)
    with pytest.raises(ValueError):
        P.Document(b"%PDF-1.4 nothing")


def test_wrapping():
    assert P.wrapped("one two three", 10_000, 10) == ["one two three"] and P.wrapped("a\n\nb", 100, 10) == ["a", "", "b"]
    lines = P.wrapped("word " * 30 + "x" * 80, 100, 10)
    assert "".join(lines).replace(" ", "") == "word" * 30 + "x" * 80 and all(P.text_width(line, 10) <= 100 for line in lines)
    assert P.drawable("a日") == b"a?"
