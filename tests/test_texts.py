"""Text queries on rows that the driver's tables don't have."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import search, text
from folioscope.plans import registry


@pytest.fixture
def put(spark, tmp_path):
    def run(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return run


def test_needles_are_whole_lines(spark, put):
    rows = [
        (1, 0, "one two three four five six\n\nsomething that is never said again"),
        (1, 1, "he said: one two thre four five six, and once more: one two three four five six"),
        (1, 2, "one two three is all that this has"),
        (1, 3, None),
    ]
    d = put("conversations", rows, "conv_id long, turn long, text string")
    got = {(r.turn, r.line): r for r in registry.queries()["approximate_search"](spark, d).collect()}
    assert got[0, 0].needle == "one two three four five six" and got[0, 2].needle == "something that is never said again"
    assert [p.distance for p in got[0, 0].places] == [0, 1] and (got[0, 0].n_places, got[0, 0].first_distance) == (2, 0)
    assert (got[0, 2].n_places, got[0, 2].first_distance) == (0, None)
    # The first three words alone would be found here.
    assert got[1, 0].n_places == 0


FULL = [(1, "ＦＵＬＬ Ｗｉｄｔｈ １２３", "en"), (2, "a ﬁne oﬃce", "en"), (3, "Café ① ㎏ ™", "en"), (4, "plain – “ascii” nearly, é", "en"), (5, None, "en"), (6, "full width 123 here", "en")]


def test_compatibility_forms(spark, put):
    d = put("documents", FULL, "doc_id long, text string, lang string")
    q = registry.queries()
    got = {r.doc_id: r.normalised for r in q["normalise_text"](spark, d).collect()}
    assert got == {1: "full width 123", 2: "a fine office", 3: "cafe 1 kg tm", 4: 'plain "ascii" nearly, e', 5: None, 6: "full width 123 here"}
    words = {r.word: r.n for r in q["bag_frequencies"](spark, d).collect()}
    assert words["full"] == 2 and words["123"] == 2 and words["fine"] == 1
    assert q["tokenise_count"](spark, d).first().words == 3 + 3 + 4 + 4 + 4
    put("benchmark", [(7, "Full ｗｉｄｔｈ 123")], "item_id long, text string")
    assert [tuple(r) for r in q["find_content_exact"](spark, d).collect()] == [(7, 2, 1)]
    put("conversations", [(1, 0, "oﬃce １"), (1, 1, "office 1")], "conv_id long, turn long, text string")
    assert q["levenshtein_similarity"](spark, d).first().similarity == 1


def test_stable_characters_are_those_that_nfkc_keeps():
    stable = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and re.match(f"[{text.STABLE}]", c)]
    # Each alone, and none of them takes part in a composition: no starter of a pair that composes ends in one of them.
    assert all(unicodedata.is_normalized("NFKC", c) and unicodedata.combining(c) == 0 for c in stable)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in stable for b in stable)


#: What normalisation must give: the fixture's own cases.
CASES = [
    ("Crème Brûlée ﬁnal ＡＢＣ Æsir", {}, "creme brulee final abc aesir"),
    ("informa-\ntion and well-known", {}, "information and well-known"),
    ("informa\u00ad \r\n tion, infor\u2010\nMation", {}, "information, infor- mation"),
    ("\u201cIt\u2019s\u201d 10\u201312\u00a0pm\u200b\u2026", {}, "\"it's\" 10-12 pm..."),
    ("Total | 1,250.00 ___ ~ \u2022 ¥ .", {}, "total 1,250.00 ¥"),
    ("Ref 1O-5S rn", {}, "ref 1o-5s rn"),
    ("Ref 1O-5S rn", {"punctuation": False, "confusables": True}, "ref lo ss m"),
    ("12!6 cl 2z", {"confusables": True}, "lzlb d zz"),
    ("Crème\t | ", {"compatibility": False, "typography": False, "dehyphenation": False, "folding": False, "case": False, "noise": False}, "Crème |"),
    ("5\u2032 6\u2033 «a» b\u00b7c d\u200ce", {}, "5' 6'' «a» b·c de"),
]


def test_normalisation_cases(spark):
    for written, options, want in CASES:
        got = spark.createDataFrame([(written,)], "t string").select(text.normalise(F.col("t"), **options).alias("n")).first().n
        assert got == want, (written, options)


def test_letters_that_fold():
    table = text.diacritics()
    assert len(table) > 780 and not any(x.isascii() for x in table)
    want = {"é": "e", "Ø": "O", "Œ": "OE", "ǅ": "Dz", "ǳ": "dz", "ſ": "l", "ẛ": "s", "ß": "s", "ẞ": "S", "Ⓐ": "A", "ｚ": "z", "ꜳ": "aa", "ʌ": "v", "ɐ": "a", "Ɖ": "D", "Ɋ": "Q", "Ⱶ": "H", "ƕ": "hv", "ŉ": "n", "ı": "i", "Ʉ": "U", "ɵ": "o", "ↄ": "c", "ꞁ": "l"}
    assert {k: table.get(k) for k in want} == want
    # Letters of their own stay.
    assert not {*"ÞþÐðŊŋĸĲĳƏəƷȷɆƫⱱⱴȡ"} & set(table)


def test_noise_is_what_has_no_letter_number_or_currency(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "É", "7", "²", "$", "€", "-", ".", "|", "~", "\x1c", "\u0301", "🙂", "𝒳", "日", " ", " ", "\t", "\n"]) for _ in range(r.randrange(40))) for _ in range(400)]
    noise = lambda t: " ".join(w for w in re.sub(r"[\t\n ]+", " ", t).split(" ") if any(unicodedata.category(x)[0] in "LN" or unicodedata.category(x) == "Sc" for x in w))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.drop_noise(F.col("t")).alias("n"), text.normalise(F.col("t"), folding=False, compatibility=False, case=False).alias("all")).collect()
    assert all(g.n == noise(g.t) == g["all"] for g in got)


def test_a_guard_is_short_and_has_all_letters():
    long = [k for k, v in text.diacritics().items() if len(v) > 1]
    guard = text._about(long)
    assert len(guard) < 150 and all(re.match(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), guard), k) for k in long)
    assert not re.search(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), guard), "aéñüÄß")


def test_content_is_found_in_one_pass_or_by_joins(spark, put, monkeypatch):
    r = random.Random(9)
    made = lambda n: " ".join(r.choice(["a", "b", "cc", "d1", "ee"]) for _ in range(n))
    pages = [(k, made(r.randrange(30))) for k in range(60)] + [(5, "a b cc d1"), (None, "a b cc d1"), (70, None), (71, "")]
    asked = [(k, made(r.randrange(6))) for k in range(40)] + [(3, "a b cc d1"), (3, "a b cc d1"), (None, "b cc d1"), (41, None), (42, "no such words"), (43, "")]
    want = Counter((p, k) for p, hay in pages for k, needle in asked if hay is not None and needle is not None and needle in hay)
    for held in (search.HELD, -1):
        monkeypatch.setattr(search, "HELD", held)
        got = search.contained(spark.createDataFrame(pages, "page long, hay string"), spark.createDataFrame(asked, "item long, needle string"), "page", "item")
        assert Counter(tuple(x) for x in got.collect()) == want
    none = search.contained(spark.createDataFrame(pages, "page long, hay string"), spark.createDataFrame([], "item long, needle string"), "page", "item")
    assert none.collect() == []
    monkeypatch.undo()
    put("benchmark", [(7, "Full ｗｉｄｔｈ 123")], "item_id long, text string")
    d = put("documents", FULL, "doc_id long, text string, lang string")
    plan = registry.queries()["find_content_exact"](spark, d)._jdf.queryExecution().executedPlan().toString()
    # Pages are normalised once: one scan, and one call of Python for NFKC.
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1
