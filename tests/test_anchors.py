"""Anchors against plain string searches on random pages."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from dimlark.operators import anchors

PIECES = ["Ø25", "R5", "4X", "±0.1", "THROUGH", "M10", "note", "İzmir", "DP", "12", ".", "5"]
WORD = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block long, line long, word long"
ITEM = "doc_id string, page int, ord long, raw string, v string, rect struct<x0:double,y0:double,x1:double,y1:double>"


def page_of(dice, n):
    return [("d", 0, float(i % 9 * 40), float(i // 9 * 12), float(i % 9 * 40 + 30), float(i // 9 * 12 + 10), dice.choice(PIECES), i // 27, i // 9 % 3, i % 9) for i in range(n)]


def plain(words, needle):
    """The first match's words on its first line, letter by letter."""
    letters = [(c, i) for i, w in enumerate(words) for c in anchors.folded(w[6]) + " "]
    body, wanted = "".join(c for c, _ in letters), anchors.folded(needle)
    at = body[:-1].find(wanted) if wanted else -1
    if at < 0:
        return None
    own = sorted({i for _, i in letters[at : at + len(wanted)]} - ({letters[at + len(wanted) - 1][1]} if wanted.endswith(" ") else set()))
    own = [words[i] for i in own if words[i][7:9] == words[own[0]][7:9]]
    return min(w[2] for w in own), min(w[3] for w in own), max(w[4] for w in own), max(w[5] for w in own)


def test_search_against_find(spark):
    dice = random.Random(4)
    words = page_of(dice, 240)
    needles = [" ".join(dice.choice(PIECES) for _ in range(dice.randrange(1, 4))) for _ in range(150)] + ["absent", "", "  ", "5 ø", "0.1 THR"]
    asked = spark.createDataFrame([("d", 0, i, ["absent too", n]) for i, n in enumerate(needles)] + [("none", 0, 999, ["R5"])], "doc_id string, page int, ord long, needles array<string>")
    shuffled = words[:]
    dice.shuffle(shuffled)
    got = {r["ord"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in anchors.searched(asked, spark.createDataFrame(shuffled, WORD)).collect()}
    want = {i: p for i, n in enumerate(needles) if (p := plain(words, n))}
    assert got == want and 20 < len(want) < len(needles)


def test_order_of_spellings_rectangles_and_margins(spark):
    words = [("d", 0, 0.0, 0.0, 20.0, 10.0, "Ø9", 0, 0, 0), ("d", 0, 30.0, 0.0, 60.0, 10.0, "THROUGH", 0, 0, 1), ("d", 0, 0.0, 50.0, 20.0, 60.0, "⌀9", 1, 0, 0)]
    items = [("d", 0, 1, "ø9 thru", "Ø9", None), ("d", 0, 2, "R7", "R7", None), ("d", 0, 3, None, "⌀9", None), ("d", 0, 4, "R8", None, None), ("d", 0, 5, "x", "x", (0.0, 2.0, 4.0, 8.0)), ("d", 0, 6, None, None, None), ("e", 1, 7, "Ø9", "Ø9", None)]
    got = anchors.anchored(spark.createDataFrame(items, ITEM).withColumn("more", F.lit(1)), spark.createDataFrame(words, WORD), 80.0)
    rows = {r["ord"]: (r["how"], r["ax"], r["ay"], r["anchored"]) for r in got.collect()}
    assert rows == {
        1: ("search", 30.0, 5.0, True), 2: ("margin", 16.0, 20.0, False), 3: ("search", 10.0, 55.0, True), 4: ("margin", 16.0, 44.0, False),
        5: ("rect", 2.0, 5.0, True), 6: ("margin", 16.0, 20.0, False), 7: ("margin", 16.0, 20.0, False),
    }


def test_page_text_places():
    page = anchors.PageText(pd.DataFrame([("B", 0, 0, 1, 5.0, 0.0, 9.0, 1.0), ("a a", 0, 0, 0, 0.0, 0.0, 4.0, 1.0)], columns=["text", "block", "line", "word", "x0", "y0", "x1", "y1"]))
    assert page.body == "a a b" and page.first_places({"a", "a b", "zz"}) == {"a": 0, "a b": 2} and page.rect(2, 3) == [0.0, 0.0, 9.0, 1.0]
