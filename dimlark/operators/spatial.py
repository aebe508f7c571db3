"""Rectangles, transforms, snapping and balloon placement."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 8.0
#: A circle reaches as far as its radius, up to so many points.
LARGEST_REACH = 25.0
# Directions in their order, and caps of the page geometry.
DIRECTIONS = {"n": (0, -1), "e": (1, 0), "s": (0, 1), "w": (-1, 0)}
MAX_CIRCLES, MAX_ENDS, MAX_SEGMENTS, MAX_RECTS = 5_000, 30_000, 12_000, 4_000


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """FIL-7: rectangles (x0, y0, x1, y1) that touch count."""
    return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])


def centre_in(word: tuple[Column, ...], rect: tuple[Column, ...]) -> Column:
    """FIL-6: edges count."""
    return ((word[0] + word[2]) / 2).between(rect[0], rect[2]) & ((word[1] + word[3]) / 2).between(rect[1], rect[3])


def word_in(word: tuple[Column, ...], rect: tuple[Column, ...]) -> Column:
    """FIL-5: a true overlap, of 0.3 of the word at least, or with the word's centre."""
    ix, iy = F.least(rect[2], word[2]) - F.greatest(rect[0], word[0]), F.least(rect[3], word[3]) - F.greatest(rect[1], word[1])
    area = F.greatest((word[2] - word[0]) * (word[3] - word[1]), F.lit(1e-6))
    return (ix > 0) & (iy > 0) & ((ix * iy / area >= 0.30) | centre_in(word, rect))


def hit_in_region(rect: Column, inc: tuple[float, ...] | None, exc: tuple[float, ...] | None) -> Column:
    """FIL-4: a hit without a place passes only where nothing is asked for, and ``exc`` does not matter then."""
    cx, cy = (rect["x0"] + rect["x1"]) / 2, (rect["y0"] + rect["y1"]) / 2
    ok = F.lit(True)
    if inc:
        ok &= cx.between(inc[0], inc[2]) & cy.between(inc[1], inc[3])
    if exc:
        ok &= ~(cx.between(exc[0], exc[2]) & cy.between(exc[1], exc[3]))
    return F.when(rect.isNull(), F.lit(inc is None)).otherwise(ok)


def sparse_pages(words: DataFrame, least: int = 4) -> DataFrame:
    """FIL-9: ``doc_id, page, sparse``: pages with fewer than ``least`` words that are not blank."""
    return words.groupBy("doc_id", "page").agg((F.count_if(F.trim("text") != "") < least).alias("sparse"))


def confident(conf: Column, least: float) -> Column:
    """FIL-8: unreadable confidences pass."""
    return F.coalesce(conf.cast("string").try_cast("double") >= least, F.lit(True))


def on_page(x: Column, y: Column, width: Column, height: Column) -> Column:
    """FIL-18: struct ``x, y``, or NULL off the page."""
    return F.when(x.between(0, width) & y.between(0, height), F.struct(x.alias("x"), y.alias("y")))


def transformed(m: Column, x: Column, y: Column) -> Column:
    """GEO-2: a point by the matrix a..f."""
    return F.struct((x * m["a"] + y * m["c"] + m["e"]).alias("x"), (x * m["b"] + y * m["d"] + m["f"]).alias("y"))


def inverse_transformed(m: Column, x: Column, y: Column) -> Column:
    """GEO-2: the way back; (0, 0) where there is none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    px, py = x - m["e"], y - m["f"]
    part = lambda v: F.when(det != 0, v / F.nullif(det, F.lit(0.0))).otherwise(0.0)
    return F.struct(part(m["d"] * px - m["c"] * py).alias("x"), part(m["a"] * py - m["b"] * px).alias("y"))


def transformed_rect(m: Column, r: tuple[Column, ...]) -> Column:
    """GEO-2: corners put in order again."""
    p, q = transformed(m, r[0], r[1]), transformed(m, r[2], r[3])
    return F.struct(F.least(p["x"], q["x"]).alias("x0"), F.least(p["y"], q["y"]).alias("y0"), F.greatest(p["x"], q["x"]).alias("x1"), F.greatest(p["y"], q["y"]).alias("y1"))


def capture_box(x: Column, y: Column, radius: float) -> Column:
    """GEO-9: a click's box, 0.75 of the radius each way, 2 at least."""
    half = max(2.0, radius * 0.75)
    return F.struct((x - half).alias("x0"), (y - half).alias("y0"), (x + half).alias("x1"), (y + half).alias("y1"))


def circle_hits_rect(cx: Column, cy: Column, r: float, rect: tuple[Column, ...]) -> Column:
    """GEO-7: touching does not count."""
    qx, qy = F.least(F.greatest(cx, rect[0]), rect[2]), F.least(F.greatest(cy, rect[1]), rect[3])
    return F.pow(qx - cx, 2) + F.pow(qy - cy, 2) < r * r


def circle_hits_segment(cx: Column, cy: Column, r: float, s: tuple[Column, ...]) -> Column:
    """GEO-7: distance to the nearest point of the segment."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    length = dx * dx + dy * dy
    t = F.when(length <= 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - s[0]) * dx + (cy - s[1]) * dy) / F.nullif(length, F.lit(0.0)))))
    return F.pow(s[0] + t * dx - cx, 2) + F.pow(s[1] + t * dy - cy, 2) < r * r


def capped(df: DataFrame, most: int, *order: str) -> DataFrame:
    """LIM-1: the first ``most`` rows of each page."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def circles(paths: DataFrame) -> DataFrame:
    """GEO-3: ``cx, cy, r`` of paths (``ord, items, x0..y1``) that are circles, up to 5000 a page."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    curves = F.size(F.filter("items", lambda i: i == "c"))
    round_ = (curves >= 3) & (F.size("items") == curves) & (w > 0.5) & (w <= 120) & (w / F.greatest(h, F.lit(1e-6))).between(0.8, 1.25)
    found = paths.where(round_).select("doc_id", "page", "ord", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), ((w + h) / 4).alias("r"))
    return capped(found, MAX_CIRCLES, "ord")


def line_ends(segments: DataFrame) -> DataFrame:
    """GEO-4: ends ``x, y`` of lines (``ord, x0..y1``) with their 8-point cell; lines from 30000 ends on are left."""
    few = capped(segments, MAX_ENDS // 2, "ord")
    ends = few.select("doc_id", "page", "ord", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("i"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("doc_id", "page", "ord", "p.*")
    return ends.withColumns({"gx": F.floor(F.col("x") / GRID), "gy": F.floor(F.col("y") / GRID)})


def obstacles(words: DataFrame, segments: DataFrame, filled: DataFrame, least_width: float = 0.5) -> DataFrame:
    """GEO-5: ``doc_id, page, kind, x0..y1``: words, filled rectangles and thick lines, the latter two up to their caps."""
    box = ("doc_id", "page", "x0", "y0", "x1", "y1")
    lines = capped(segments.where(F.col("width") >= least_width), MAX_SEGMENTS, "ord")
    return words.select(*box).withColumn("kind", F.lit("rect")).union(capped(filled, MAX_RECTS, "ord").select(*box).withColumn("kind", F.lit("rect"))).union(lines.select(*box).withColumn("kind", F.lit("seg")))


def snapped(points: DataFrame, rings: DataFrame, ends: DataFrame, zoom: float = 1.0) -> DataFrame:
    """GEO-6: ``points(doc_id, page, id, px, py)`` -> ``sx, sy, how``: the nearest circle's centre, else the nearest line end.

    Circles and line ends meet the cells around a point by equi-joins; ties go to the earlier ``ord``.
    """
    reach_c, reach_e = 9.0 / max(zoom, 0.3), 5.0 / max(zoom, 0.3)
    d2 = lambda x, y: F.pow(F.col(x) - F.col("px"), 2) + F.pow(F.col(y) - F.col("py"), 2)
    key = ["doc_id", "page", "id"]

    def around(size: float, cells: int) -> DataFrame:
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in product(range(-cells, cells + 1), repeat=2)])
        near = points.select("*", F.explode(steps).alias("step"))
        return near.select(*key, "px", "py", (F.floor(F.col("px") / size) + F.col("step.i")).alias("gx"), (F.floor(F.col("py") / size) + F.col("step.j")).alias("gy"))

    cell = max(reach_c, LARGEST_REACH)
    centres = rings.withColumns({"gx": F.floor(F.col("cx") / cell), "gy": F.floor(F.col("cy") / cell)})
    near = around(cell, 1).join(centres, ["doc_id", "page", "gx", "gy"]).withColumn("d2", d2("cx", "cy"))
    near = near.where(F.col("d2") <= F.pow(F.greatest(F.lit(reach_c), F.least("r", F.lit(LARGEST_REACH))), 2))
    ring = near.groupBy(*key).agg(F.min(F.struct("d2", "ord", "cx", "cy")).alias("ring"))
    met = around(GRID, max(1, int(reach_e // GRID) + 1)).join(ends, ["doc_id", "page", "gx", "gy"]).withColumn("d2", d2("x", "y")).where(F.col("d2") <= reach_e * reach_e)
    end = met.groupBy(*key).agg(F.min(F.struct("d2", "ord", "i", "x", "y")).alias("end"))
    out = points.join(ring, key, "left").join(end, key, "left")
    how = F.when(F.col("ring").isNotNull(), "hole center").when(F.col("end").isNotNull(), "line end")
    return out.select(*key, F.coalesce("ring.cx", "end.x", "px").alias("sx"), F.coalesce("ring.cy", "end.y", "py").alias("sy"), how.alias("how"))


def candidate_places(ax: float, ay: float, rect: tuple[float, ...] | None, radius: float, width: float, height: float, prefer: str) -> list[tuple[int, float, float]]:
    """(tier, x, y) of places for a balloon in order: free of everything, then of balloons, then any."""
    clear = radius * 1.9
    ways = sorted(DIRECTIONS.items(), key=lambda d: d[0] != prefer)

    def place(dx: float, dy: float, extra: float = 0.0) -> tuple[float, float]:
        x = ax if rect is None or dx == 0 else rect[2] if dx > 0 else rect[0]
        y = ay if rect is None or dy == 0 else rect[3] if dy > 0 else rect[1]
        return x + dx * (clear + extra), y + dy * (clear + extra)

    out = []
    for ring in range(4):
        slanted = [(sx * 0.7071, sy * 0.7071) for sx in (1, -1) for sy in (-1, 1)] if ring else []
        out += [(0, *place(dx, dy, ring * radius * 1.6)) for dx, dy in [d for _, d in ways] + slanted]
    out += [(1, *place(*d)) for _, d in ways]
    out += [(1, min(ax + radius * (1 + e) + radius * 0.9, width - radius - 2), max(ay - radius * e, radius + 2)) for e in range(1, 9)]
    return [*out, (2, *place(*ways[0][1]))]


class Cells:
    """Things by the square cells that their boxes touch; those over very many cells are kept apart and are always near."""

    MANY = 1024

    def __init__(self, size: float):
        self.size, self.held, self.wide = size, defaultdict(list), []

    def reach(self, x0: float, y0: float, x1: float, y1: float) -> tuple[range, range] | None:
        """The cells of a box; None if its edges are no numbers."""
        if not all(map(math.isfinite, (x0, y0, x1, y1))):
            return None
        span = lambda a, b: range(math.floor(min(a, b) / self.size), math.floor(max(a, b) / self.size) + 1)
        return span(x0, x1), span(y0, y1)

    def put(self, thing: tuple, x0: float, y0: float, x1: float, y1: float) -> None:
        cells = self.reach(x0, y0, x1, y1)
        if cells is None or len(cells[0]) * len(cells[1]) > self.MANY:
            self.wide.append(thing)
        else:
            for key in product(*cells):
                self.held[key].append(thing)

    def near(self, x: float, y: float, r: float) -> Iterator[tuple]:
        """What may be within ``r`` of a point, some perhaps more than once."""
        yield from self.wide
        for key in product(*(self.reach(x - r, y - r, x + r, y + r) or ())):
            yield from self.held.get(key, ())


def far(x: float, y: float, radius: float, thing: tuple) -> bool:
    """Whether a balloon there leaves an obstacle free: rectangles nearly by its radius, lines by less."""
    kind, x0, y0, x1, y1 = thing
    if kind == "rect":
        return math.hypot(min(max(x, x0), x1) - x, min(max(y, y0), y1) - y) >= radius * 0.92
    dx, dy = x1 - x0, y1 - y0
    along = dx * dx + dy * dy
    t = 0.0 if along <= 1e-9 else min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / along))
    return math.hypot(x0 + t * dx - x, y0 + t * dy - y) >= radius * 0.8


def placed(anchors: DataFrame, obstacle_table: DataFrame, pages: DataFrame, radius: float = 9.0, prefer: str = "auto", compat_offset: bool = False) -> DataFrame:
    """GEO-8: ``anchors(doc_id, page, ord, ax, ay, rx0..ry1)`` -> ``ord, bx, by``; ``pages(doc_id, page, width, height)``.

    A balloon is an obstacle to those after it, so a page is placed in order by one group, which
    meets the page's obstacles once, in cells. With ``compat_offset`` only the first new balloon
    is one.
    """
    key = ["doc_id", "page"]
    rows = anchors.join(pages.select(*key, "width", "height"), key)
    things = obstacle_table.select(*key, "kind", "x0", "y0", "x1", "y1").join(rows.select(*key).distinct(), key, "left_semi")
    # names of their own: both sides may come from one table
    things = things.toDF("__doc", "__page", "kind", "x0", "y0", "x1", "y1")
    kind = anchors.schema["doc_id"].dataType.simpleString()

    def page(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            blocks, balloons = Cells(4 * radius), Cells(4 * radius)
            for thing in zip(*(around[c] for c in ("kind", "x0", "y0", "x1", "y1")), strict=True):
                blocks.put(thing, *thing[1:])
            width, height = own["width"].iloc[0], own["height"].iloc[0]

            def free(tier: int, x: float, y: float) -> bool:
                if tier == 2:
                    return True
                if not (2 <= x - radius and x + radius <= width - 2 and 2 <= y - radius and y + radius <= height - 2):
                    return False
                apart = all(math.hypot(px - x, py - y) >= radius * 2.4 for px, py in balloons.near(x, y, radius * 2.4))
                return apart and (tier == 1 or all(far(x, y, radius, b) for b in blocks.near(x, y, radius)))

            for row in own.sort_values("ord").itertuples(index=False):
                rect = None if pd.isna(row.rx0) else (row.rx0, row.ry0, row.rx1, row.ry1)
                x, y = next((x, y) for tier, x, y in candidate_places(row.ax, row.ay, rect, radius, width, height, prefer) if free(tier, x, y))
                if not (compat_offset and out):
                    balloons.put((x, y), x, y, x, y)
                out.append((row.doc_id, row.page, row.ord, x, y))
        return pd.DataFrame(out, columns=["doc_id", "page", "ord", "bx", "by"])

    return rows.groupBy(*key).cogroup(things.groupBy("__doc", "__page")).applyInPandas(page, f"doc_id {kind}, page int, ord long, bx double, by double")
