"""The reader of each region, capture rectangles, and the grid join of centres with regions."""

from __future__ import annotations

import random

import pandas as pd

from dimlark.operators import detect

WORD = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block long, line long, word long"
BOX = "doc_id string, page int, region long, x0 double, y0 double, x1 double, y1 double, cls int"


def fixed(texts, conf=1.0):
    """A reader that finds the same texts in each region of the named numbers, down from the crop's corner; local, so that it travels by value."""

    class Fixed:
        def load(self):
            self.loaded = True

        def read_regions(self, pages):
            assert self.loaded
            for pdf in pages:
                out = [
                    (r.doc_id, r.page, r.region, i, [{"x": 0.0, "y": i * 30.0}, {"x": 60.0, "y": i * 30.0 + 20}], text, conf, r.rx0, r.ry0, r.scale)
                    for r in pdf.itertuples(index=False)
                    for i, text in enumerate(texts.get(r.region, ()))
                ]
                yield pd.DataFrame(out, columns=["doc_id", "page", "region", "ord", "points", "text", "conf", "dx", "dy", "scale"])

    return Fixed()


def tables(spark):
    """Regions 0 to 3 one under the other: two words, one word, none, and a note; page 1 is the same without an image."""
    said = ((0.0, 0.0, "Ø9", 0), (30.0, 0.0, "H7", 0), (0.0, 100.0, "R5", 1), (0.0, 300.0, "R7", 3), (20.0, 300.0, "R8", 3))
    words = spark.createDataFrame([("d", page, x, y, x + 12, y + 10, t, b, 0, int(x)) for page in (0, 1) for x, y, t, b in said], WORD)
    boxes = spark.createDataFrame([("d", page, r, -5.0, r * 100.0 - 5, 200.0, r * 100.0 + 60, cls) for page in (0, 1) for r, cls in enumerate((0, 1, 2, 7))], BOX)
    images = spark.createDataFrame([("d", 0, b"img", 2.0)], "doc_id string, page int, image binary, scale double")
    return words, boxes, images


def told(result):
    reads, hits = result
    return {(r["page"], r["region"]): r["reader"] for r in reads.collect()}, sorted((r["page"], r["region"], r["cg"], r["v"]) for r in hits.collect())


def test_text_vlm_ocr_and_back(spark):
    words, boxes, images = tables(spark)
    vlm, ocr = fixed({2: ["R40", "M8"]}), fixed({1: ["R6"], 2: ["R41"]}, 0.6)
    reads, hits = told(detect.routed_hits(words, boxes, images, {"vlm": vlm, "ocr": ocr}))
    assert reads == {(0, 0): "text", (0, 1): "text", (0, 2): "vlm", (1, 0): "text", (1, 1): "text", (1, 2): "text"}
    assert hits == [(0, 0, 0, "Ø9 H7"), (0, 1, 1000, "R5"), (0, 2, 2000, "R40"), (0, 2, 2001, "M8"), (1, 0, 0, "Ø9 H7"), (1, 1, 1000, "R5")]
    reads, hits = told(detect.routed_hits(words, boxes, images, {"ocr": ocr}))
    assert reads[0, 1] == reads[0, 2] == "ocr" and reads[1, 2] == "text"
    assert [h for h in hits if h[0] == 0] == [(0, 0, 0, "Ø9 H7"), (0, 1, 1000, "R6"), (0, 2, 2000, "R41")]


def test_force_and_symbols(spark):
    words, boxes, images = tables(spark)
    marks = spark.createDataFrame([("d", 0, 1, -4.0, 201.0, -1.0, 209.0, "Ø"), ("d", 0, 2, -4.0, 1.0, -1.0, 9.0, "R")], "doc_id string, page int, ord long, x0 double, y0 double, x1 double, y1 double, symbol string")
    vlm = fixed({0: ["R1"], 2: ["40"]})
    reads, hits = told(detect.routed_hits(words, boxes, images, {"vlm": vlm}, symbols=marks, force_vlm=True))
    assert (reads[0, 0], reads[0, 1], reads[0, 2]) == ("vlm", "text", "vlm")
    assert (0, 2, 2000, "Ø40") in hits and (0, 0, 0, "R1") in hits
    assert not any(h[3] == "Ø40" for h in told(detect.routed_hits(words, boxes, images, {"vlm": vlm}, symbols=marks, inject_vlm=False))[1])


def test_capture_renumbers_regions_and_cuts_containers(spark):
    words, boxes, images = tables(spark)
    capture = spark.createDataFrame([("d", 0, 0.0, 108.0, 50.0, 208.0)], "doc_id string, page int, cx0 double, cy0 double, cx1 double, cy1 double")
    vlm = fixed({1: ["R40", "M8"]})
    reads, hits = told(detect.routed_hits(words, boxes, images, {"vlm": vlm}, capture=capture))
    assert {k: v for k, v in reads.items() if k[0] == 0} == {(0, 0): "text", (0, 1): "vlm"}
    assert [h for h in hits if h[0] == 0] == [(0, 0, 0, "R5"), (0, 1, 1000, "R40")], "M8 lies below the rectangle, R5's region is no container"
    assert len([k for k in reads if k[0] == 1]) == 3, "a page without a rectangle is taken whole"


def test_grid_join_against_all_pairs(spark):
    dice = random.Random(3)
    words = [(d, p, x := dice.uniform(-500, 900), y := dice.uniform(-50, 2000), x + 10, y + 8, "w", i, 0, 0) for d in "ab" for p in (0, 1) for i in range(150)]
    boxes = [(d, p, r, x := dice.uniform(-600, 900), y := dice.uniform(-60, 1900), x + dice.choice([-3, 0, 1, 32, 64, 90, 5000]), y + dice.choice([0, 10, 64, 700]), 0) for d in "ac" for p in (0, 1) for r in range(40)]
    boxes += [("a", 0, 99, 5.0, 4.0, 5.0, 4.0, 0)]
    words += [("a", 0, 0.0, 0.0, 10.0, 8.0, "on the edge", 999, 0, 0)]
    got = detect.centred_in(spark.createDataFrame(words, WORD), detect.boxed(spark.createDataFrame(boxes, BOX))).select("doc_id", "page", "block", "region").collect()
    want = [(w[0], w[1], w[7], b[2]) for w in words for b in boxes if w[:2] == b[:2] and b[3] <= (w[2] + w[4]) / 2 <= b[5] and b[4] <= (w[3] + w[5]) / 2 <= b[6]]
    assert sorted(map(tuple, got)) == sorted(want) and ("a", 0, 999, 99) in want
