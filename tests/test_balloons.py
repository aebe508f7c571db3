"""Balloon placement on crowded pages against a loop over every obstacle and balloon."""

from __future__ import annotations

import math
import random

import pytest

from dimlark.operators import spatial

R = 9.0
ANCHOR = "doc_id string, page int, ord long, ax double, ay double, rx0 double, ry0 double, rx1 double, ry1 double"
THING = "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double"


def crowd(seed, doc, anchors, things, side):
    dice = random.Random(seed)
    at = lambda: dice.uniform(0, side)
    rows = []
    for i in range(anchors):
        x, y = at(), at()
        rows.append((doc, 0, i, x, y, *((x - 5, y - 3, x + 5, y + 3) if i % 3 == 0 else (None,) * 4)))
    blocks = []
    for i in range(things):
        x, y = at(), at()
        dx, dy = dice.choice([(20, 6), (3, 3), (60, 0), (0, 80), (-40, 30), (0, 0)]) if i else (side * 3, 1)
        kind = "seg" if i % 2 == 0 or dx < 0 else "rect"
        blocks.append((doc, 0, kind, x, y, float(x + dx), float(y + dy)))
    return rows, blocks


def hits(x, y, thing):
    _, _, kind, x0, y0, x1, y1 = thing
    if kind == "rect":
        px, py, r = min(max(x, x0), x1), min(max(y, y0), y1), 0.92 * R
    else:
        n = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = 0 if n <= 1e-9 else min(1, max(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n))
        px, py, r = x0 + t * (x1 - x0), y0 + t * (y1 - y0), 0.8 * R
    return math.hypot(px - x, py - y) < r


def plain(rows, blocks, side):
    out, taken = {}, []
    for _, _, i, ax, ay, *rect in rows:
        for tier, x, y in spatial.candidate_places(ax, ay, None if rect[0] is None else rect, R, side, side, "auto"):
            inside = 2 <= x - R and x + R <= side - 2 and 2 <= y - R and y + R <= side - 2
            if tier == 2 or (inside and all(math.hypot(a - x, b - y) >= 2.4 * R for a, b in taken) and (tier == 1 or not any(hits(x, y, b) for b in blocks))):
                out[i] = (x, y)
                taken.append((x, y))
                break
    return out


def test_crowded_pages_against_a_plain_loop(spark):
    pages = spark.createDataFrame([(d, 0, 600.0, 600.0) for d in "abc"], "doc_id string, page int, width double, height double")
    one, two = crowd(1, "a", 80, 400, 600.0), crowd(2, "b", 60, 1500, 600.0)
    lonely = [("c", 0, 0, 300.0, 300.0, None, None, None, None)]
    got = spatial.placed(spark.createDataFrame(one[0] + two[0] + lonely, ANCHOR), spark.createDataFrame(one[1] + two[1] + [("x", 0, "rect", 0.0, 0.0, 1.0, 1.0)], THING), pages).collect()
    found = {(r["doc_id"], r["ord"]): (r["bx"], r["by"]) for r in got}
    want = {("a", i): p for i, p in plain(*one, 600.0).items()} | {("b", i): p for i, p in plain(*two, 600.0).items()} | {("c", 0): plain(lonely, [], 600.0)[0]}
    assert set(found) == set(want)
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_cells_examine_few(monkeypatch):
    cells = spatial.Cells(36.0)
    _, blocks = crowd(3, "a", 0, 16_000, 3000.0)
    for b in blocks:
        cells.put(b, *b[3:])
    near = [len(list(cells.near(x * 10.0, x * 7.0, R))) for x in range(300)]
    assert sum(near) / len(near) < 60 and len(cells.wide) < 3
    for x, y in ((100.0, 200.0), (1500.0, 1500.0)):
        assert {b for b in blocks if hits(x, y, b)} <= set(cells.near(x, y, R))
