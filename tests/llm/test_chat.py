"""Quotation linking on small conversations."""

import random

import pytest

from folioscope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def test_parse():
    text, own, quotes = chat.parse("On Monday Ann wrote:\n> > deep  Line\n> Shallow\n\nmy answer\n>\n")
    assert text.strip() == "my answer"
    assert own == [chat.digest("my answer")]
    assert quotes == [(2, chat.digest("deep line")), (1, chat.digest("shallow"))]
    assert chat.parse("a -> b\n3 > 2")[0] == "a -> b\n3 > 2"
    assert chat.parse("") == ("", [], [])


def test_threads(spark):
    rows = [
        (1, 0, "user", "First question.\nWith two lines.", 9),
        (1, 1, "assistant", "An answer.", 9),
        (1, 2, "user", ">> first   QUESTION.\n> An answer.\n> an answer.\nThanks", 9),
        (1, 3, "user", "> With two lines.\n> First question.\nAnother", 9),
        (1, 4, "assistant", "Plain", 9),
        (1, 5, "user", "> never said\nHm", 9),
        (1, 6, "user", "> Hm later\nSelf", 9),
        (2, 5, None, None, None),
        (2, 5, "user", "variant", None),
        (2, 9, "user", "> variant", None),
        (None, 1, "user", "lost", 1),
        (3, None, "user", "> lost", 1),
    ]
    got = {(r.conv_id, r.turn, r.role): r for r in chat.threaded(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    of = lambda *k: tuple(got[k][4:])
    assert of(1, 0, "user") == (None, 0, 0, 0, 0, 1)
    assert got[1, 2, "user"].text == "Thanks" and of(1, 2, "user")[:5] == (1, 2, 2, 2, 0)
    assert of(1, 3, "user")[:5] == (0, 2, 2, 1, 0)
    assert of(1, 4, "assistant")[:5] == (3, 0, 0, 2, 0)
    assert of(1, 5, "user")[:5] == (4, 1, 0, 3, 0)
    assert of(2, 5, None)[-1] == 1 and of(2, 5, "user")[-1] == 2 and got[2, 9, "user"].reply_to == 5 and got[2, 9, "user"].text == ""
    assert got[None, 1, "user"].position is None and got[3, None, "user"].reply_to is None
    assert chat.threaded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_replies_by_brute_force(spark):
    r = random.Random(8)
    rows, want = [], {}
    for c in range(25):
        own, depth = [], []
        for t in range(r.randrange(1, 12)):
            lines = [f"c{c} t{t} l{k} {r.random()}" for k in range(3)]
            answered = t - 1 if t else None
            quoted = []
            if t and r.random() < 0.6:
                answered = r.randrange(t)
                quoted = ["> " + x.upper() for x in r.sample(own[answered], 2)]
            own.append(lines)
            depth.append(0 if answered is None else depth[answered] + 1)
            want[c, t] = (answered, len(quoted), depth[-1])
            rows.append((c, t, "user", "\n".join(quoted + lines), 0))
    got = chat.threaded(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.conv_id, x.turn): (x.reply_to, x.n_linked, x.depth) for x in got} == want
    at = {(x.conv_id, x.turn): x.position for x in got}
    assert all(x.reply_to is None or at[x.conv_id, x.reply_to] < x.position for x in got)


def test_rewrapped_and_trimmed_quotes(spark):
    long = "The parcel left the depot on Monday. It was weighed twice before noon, and nobody signed for it. Please ask the driver."
    rows = [
        (1, 0, "user", long, 0),
        (1, 1, "assistant", "A first reply\nwhich the writer had wrapped by hand\nover three short lines", 0),
        (1, 2, "user", "Something else between them", 0),
        # One line quoted as several, several as one, a sentence alone, a part of a sentence, and words that no one wrote.
        (1, 3, "user", "> The parcel left the depot on\n> Monday. It was weighed twice before noon, and\n> nobody signed for it.\nSo?", 0),
        (1, 4, "user", "> A first reply which the writer had wrapped by hand over three short lines\nYes", 0),
        (1, 5, "user", ">> Please ask the driver.\nDone", 0),
        (1, 6, "user", "> ... weighed twice before noon, and nobody signed\nWhy", 0),
        (1, 7, "user", "> The parcel left by ship and never came near any depot at all\nNo", 0),
        (2, 0, "user", "An unrelated start", 0),
        (2, 1, "user", "> It was weighed twice before noon, and nobody signed for it.\nHm", 0),
    ]
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked) for r in chat.threaded(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got[1, 3] == (0, 3, 3)
    assert got[1, 4] == (1, 1, 1)
    assert got[1, 5] == (0, 1, 1)
    assert got[1, 6] == (0, 1, 1)
    assert got[1, 7] == (6, 1, 0)
    assert got[2, 1] == (0, 1, 0)


@pytest.mark.parametrize("partitions", [1, 5])
def test_conversations_over_many_ranges(spark, partitions):
    rows = [("long", i, "u", f"message {i}") for i in range(0, 120, 3)] + [("b", 4, "u", "x"), ("b", "no turn", "u", "y"), (None, 3, "u", "z"), ("a", 1, "u", "first"), ("a", 2, "v", "> first\n\nyes"), ("a", 2, "u", "> first\n\nno"), ("a", 2, "u", "> first\n\nno")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        df = spark.createDataFrame([(c, str(t), r, x) for c, t, r, x in rows], "conv_id string, turn string, role string, text string")
        got = [r.asDict() for r in chat.threaded(df).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    long = sorted((r["position"], r["turn"], r["reply_to"], r["depth"]) for r in got if r["conv_id"] == "long")
    assert long == [(k + 1, 3 * k, 3 * k - 3 if k else None, k) for k in range(40)]
    a = sorted((r["position"], r["turn"], r["role"], r["reply_to"], r["text"]) for r in got if r["conv_id"] == "a")
    assert a == [(1, 1, "u", None, "first"), (2, 2, "u", 1, "\nno".strip()), (3, 2, "u", 1, "no"), (4, 2, "v", 1, "yes")]
    assert {(r["conv_id"], r["position"]) for r in got if r["turn"] is None or r["conv_id"] is None} == {("b", None), (None, None)}
