"""What larger tables showed: numbers of seven digits, angles at the turn, full sheets, pages of many signs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from dimlark.operators import detect, ledger
from dimlark.plans import drawing_queries, fixtures
from dimlark.schema import FIRST_ROW, LAST_ROW
from dimlark.sources import labels, sheet


def test_codes_of_more_than_six_digits_stay_whole(spark):
    """image 1000001 had the code of image 000001."""
    names = ["/i/shot_000001.png", "/i/shot_1000001.png", "/i/shot_00001.png", "/i/1234567_000002.png", "/i/000003.jpg"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, path string")
    assert [r["c"] for r in df.orderBy("i").select(labels.image_code(F.col("path")).alias("c")).collect()] == ["000001", "1000001", None, "000002", None]


def test_an_item_at_the_turn_comes_first(spark):
    """the second item lies at 225° of the centre, which is a rounded third; 359.99999999999994 put it last."""
    items = [("d", 1, i, x, y, True) for i, (x, y) in enumerate(((561.0, 409.0), (539.0, 267.0), (573.0, 69.0)))]
    df = ledger.clockwise(spark.createDataFrame(items, "doc_id string, page int, ord int, ax double, ay double, anchored boolean"))
    got = {r["ord"]: r for r in df.collect()}
    assert got[1]["cw_ord"] == 1 and got[1]["angle"] == 0.0
    assert [got[i]["cw_ord"] for i in (2, 0)] == [2, 3] and round(got[2]["angle"], 6) == 139.88701


def test_slots_are_reckoned_from_the_rows_held(spark):
    """free slots against a plain loop: repeated, foreign and missing rows, a sheet that fills up; no row for each slot."""
    rng, rows = random.Random(11), []
    for d in range(12):
        held = [rng.choice([None, None, rng.randint(FIRST_ROW - 3, FIRST_ROW + 12), LAST_ROW + 5]) for _ in range(rng.randint(1, 30))] + [None] * (320 if d == 0 else 0)
        rows += [(f"d{d}", i, r) for i, r in enumerate(held)]
    rows.append((None, 0, None))
    df = spark.createDataFrame(rows, "doc_id string, seq long, sheet_row int")
    want = []
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        free = (n for n in range(FIRST_ROW, LAST_ROW + 1) if d is not None and n not in {r[2] for r in own})
        want += [(d, i, r if r is not None else next(free, None), r is None) for _, i, r in own]
    got = sheet.allocated(df)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["seq"], r["sheet_row"], r["is_new"])) for r in got.collect())
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def dealt(df) -> list[str]:
    """Columns by which a plan deals rows out."""
    return re.findall(r"Exchange hashpartitioning\(([^#]+)", df._jdf.queryExecution().executedPlan().toString())


#: Queries whose rows are whole pages: texts are dealt out once, words never.
WHOLE_PAGES = ["DET-12-signs", "DET-12", "DET-6-words", "DET-6"]


@pytest.mark.parametrize("name", WHOLE_PAGES)
def test_words_are_not_dealt_out(spark, sf, name):
    """F2, F3, F7, F8: words as rows went through up to three shuffles, each eleven times the documents' size."""
    df = drawing_queries.QUERIES[name](spark, sf)
    assert len(dealt(df)) == 1 and "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def plain_symbols(words, symbols):
    """A page's symbols one after the other over all its words, without Spark."""
    ws = [dict(zip(detect.WORD_ORDER, w, strict=True)) for w in sorted(words)]
    fold = lambda t: {"ø": "Ø", "⌀": "Ø"}.get(t[:1], t[:1])
    for _, x0, y0, x1, y1, sign in sorted(symbols):
        h = max(y1 - y0, 2.0)
        fit = [(w["x0"] - x1, i) for i, w in enumerate(ws) if re.match(r"[.\dØR]", fold(w["text"]), re.A) and abs((w["y0"] + w["y1"]) / 2 - (y0 + y1) / 2) <= 0.7 * h and -0.5 * h <= w["x0"] - x1 <= 3.0 * h]
        if not fit:
            ws.append(dict(zip(detect.WORD_ORDER, (detect.VISION_BLOCK + len(ws), 0, 0, x0, y0, x1, y1, sign), strict=True)))
        elif not ((w := ws[min(fit)[1]])["text"].startswith(sign) or len(sign) == 1 and fold(w["text"]) == fold(sign)):
            w |= {"x0": min(x0, w["x0"]), "y0": min(y0, w["y0"]), "x1": max(x1, w["x1"]), "y1": max(y1, w["y1"]), "text": sign + w["text"]}
    return [tuple(w.values()) for w in ws]


def test_symbols_against_a_plain_loop(spark):
    """only words that a symbol fits are folded over; crowded pages, where symbols meet grown words and each other."""
    rng, words, symbols = random.Random(5), {}, {}
    for d in range(6):
        size = 60 if d < 5 else 600
        spot = lambda: (float(rng.randint(0, size)), float(rng.randint(0, size)))  # noqa: B023,E731
        words[f"d{d}"] = [(i // 9, i % 9, i, x, y, x + 12, y + rng.choice((8, 10)), rng.choice(("12", ".5", "R3", "Ø7", "⌀4", "note", "", "x1"))) for i in range(4 * size // 3) for x, y in [spot()]]
        symbols[f"d{d}"] = [(i, x, y, x + 6, y + rng.choice((1, 7, 12)), rng.choice(("Ø", "R", "⌖", "SR"))) for i in range(size // 3) for x, y in [spot()]]
    symbols["only"] = [(0, 0.0, 0.0, 5.0, 5.0, "Ø"), (1, -6.0, 0.0, -1.0, 5.0, "R")]
    df = spark.createDataFrame([(d, 0, *w) for d, ws in words.items() for w in ws], "doc_id string, page int, block long, line long, word long, x0 double, y0 double, x1 double, y1 double, text string")
    marks = spark.createDataFrame([(d, 0, *s) for d, ss in symbols.items() for s in ss], "doc_id string, page int, ord long, x0 double, y0 double, x1 double, y1 double, symbol string")
    got = detect.with_symbols(df, marks)
    assert len(dealt(got)) == 1
    want = [(d, *w) for d in symbols for w in plain_symbols(words.get(d, []), symbols[d])]
    assert sorted(want) == sorted((r["doc_id"], *[r[c] for c in detect.WORD_ORDER]) for r in got.collect())
    assert sum(w[1] >= detect.VISION_BLOCK for w in want) > 30 and any(w[8].startswith("RØ") for w in want)


def test_pages_hold_the_words(spark, sf):
    """The two forms of the documents' words are the same."""
    flat = fixtures.words(spark, sf).select("doc_id", "page", *detect.WORD_FIELDS)
    pages = detect.exploded_words(fixtures.word_pages(spark, sf), ("doc_id", "page"))
    assert flat.exceptAll(pages).isEmpty() and pages.exceptAll(flat).isEmpty() and pages.schema.simpleString() == flat.schema.simpleString()


def test_regions_of_whole_pages_against_the_grid_join(spark, sf):
    """words went through a shuffle by page and one by cell for each size of region; pages of any boxes give the same pairs."""
    assert len(dealt(drawing_queries.QUERIES["FIL-5-regions"](spark, sf))) == 1
    rng = random.Random(8)
    words, boxes = [], []
    for d in range(4):
        words += [(f"d{d}", 0, i, x, y, x + rng.randint(0, 20), y + 10) for i in range(150) for x, y in [(float(rng.randint(-50, 400)), float(rng.randint(-50, 400)))]]
        for k in range(25 if d else 0):
            x, y = float(rng.randint(-60, 380)), float(rng.randint(-60, 380))
            boxes.append((f"d{d}", 0, k, x, y, x + rng.choice((-5, 0, 30, 300)), y + rng.choice((0, 9, 200))))
    items = spark.createDataFrame(words, "doc_id string, page int, word long, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame(boxes, "doc_id string, page int, region long, rx0 double, ry0 double, rx1 double, ry1 double")
    pages = detect.by_page(("doc_id", "page"), ws=(items, "struct<word:bigint,x0:double,y0:double,x1:double,y1:double>"), boxes=(regions, "struct<region:bigint,rx0:double,ry0:double,rx1:double,ry1:double>"))
    got = sorted(map(tuple, detect.centred_on(pages).select("doc_id", "w.word", "b.region").collect()))
    assert got == sorted(map(tuple, detect.centred_in(items, regions).select("doc_id", "word", "region").collect())) and len(got) > 100
