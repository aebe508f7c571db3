"""Detections: decoding, suppression, symbols attached to words, regions and their callouts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GLYPHS
from ..schema import ADMITTED, CATEGORIES
from .lines import MERGES, gap_lines, merged_lines, normalized_words, with_keywords
from .scan import dedup_hits, greedy_keep, parse_lines

#: Block numbers from here on mark words that no text layer gave. Fixed value.
VISION_BLOCK = 900_000
WORD_FIELDS = ("x0", "y0", "x1", "y1", "text", "block", "line", "word")
#: A word and a symbol within a page's row; as structs are compared by their fields in turn, they sort in the page's order.
WORD_TYPE = "struct<block:bigint,line:bigint,word:bigint,x0:double,y0:double,x1:double,y1:double,text:string>"
SYMBOL_TYPE = "struct<ord:bigint,x0:double,y0:double,x1:double,y1:double,symbol:string>"
#: Signs with which a number's text begins, as they stand or once folded. Fixed values.
NUMBER_STARTS = sorted({c for c in {*".0123456789ØR", *GLYPHS} if GLYPHS.get(c, c) in ".0123456789ØR"})
WORD_ORDER = ("block", "line", "word", "x0", "y0", "x1", "y1", "text")


class Reader(Protocol):
    """DET-13: what reads words from page images; it runs inside Arrow batches of the workers."""

    def load(self) -> None: ...

    def read_regions(self, pages: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]: ...


def read_with(pages: DataFrame, reader: Reader, schema: str) -> DataFrame:
    """DET-5, DET-8: a reader over pages, loaded once in each task."""

    def run(batches):
        reader.load()
        yield from reader.read_regions(batches)

    return pages.mapInPandas(run, schema)


def chosen_reader(preferred: list[str], available: list[str]) -> str | None:
    """DET-13: the first preferred reader that is available."""
    return next((name for name in preferred if name in available), None)


def chosen_readers(preferred: Column, available: Column) -> Column:
    """DET-13 for many pages: each row's first preferred reader that is available, or NULL."""
    return F.try_element_at(F.array_intersect(preferred, available), F.lit(1))


def decoded(anchors: DataFrame, classes: int, min_conf: float, has_angle: bool = False) -> DataFrame:
    """DET-1: ``doc_id, page, ord, head array<double>`` (cx, cy, w, h, class scores, angle) -> detections.

    With an angle the box is the envelope of the turned one.
    """
    h = F.col("head")
    scores = F.slice(h, 5, classes)
    conf = F.array_max(scores)
    if has_angle:
        a = h[4 + classes]
        dx = F.abs(h[2] / 2 * F.cos(a)) + F.abs(h[3] / 2 * F.sin(a))
        dy = F.abs(h[2] / 2 * F.sin(a)) + F.abs(h[3] / 2 * F.cos(a))
    else:
        dx, dy = h[2] / 2, h[3] / 2
    out = anchors.select(
        "doc_id", "page", "ord", (h[0] - dx).alias("x0"), (h[1] - dy).alias("y0"), (h[0] + dx).alias("x1"), (h[1] + dy).alias("y1"), conf.alias("conf"), (F.array_position(scores, conf) - 1).cast("int").alias("cls")
    )
    return out.where(F.col("conf") >= min_conf)


def decoded_rows(rows: DataFrame, min_conf: float) -> DataFrame:
    """DET-1: heads that are suppressed already: x0, y0, x1, y1, conf, class."""
    h = F.col("head")
    out = rows.select("doc_id", "page", "ord", *[h[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "conf"))], F.bround(h[5], 0).cast("int").alias("cls"))
    return out.where(F.col("conf") >= min_conf)


def iou(a: Column, b: Column) -> Column:
    """DET-3."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    inter = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def suppressed(dets: DataFrame, threshold: float = 0.45, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """DET-2: from the highest confidence down, boxes that overlap none kept of their class by ``threshold``; ``ord`` breaks ties."""
    box = F.struct((F.lit(0.0) - F.col("conf")).alias("neg"), "ord", "x0", "y0", "x1", "y1", "conf", "cls")
    pages = dets.groupBy(*keys, "cls").agg(F.array_sort(F.collect_list(box)).alias("d"))
    kept = greedy_keep(F.col("d"), lambda k, x: iou(k, x) >= threshold)
    return pages.select(*keys, F.explode_outer(kept).alias("k")).where("k IS NOT NULL").select(*keys, "k.ord", "k.x0", "k.y0", "k.x1", "k.y1", "k.conf", "k.cls")


def letterbox(width: Column, height: Column, size: int = 640) -> Column:
    """DET-4: struct ``ratio, pad_x, pad_y`` of an image fitted into a square."""
    ratio = F.least(size / width, size / height)
    return F.struct(ratio.alias("ratio"), ((size - width * ratio) / 2).alias("pad_x"), ((size - height * ratio) / 2).alias("pad_y"))


def unletterboxed(dets: DataFrame, fit: Column, scale: Column) -> DataFrame:
    """DET-4: boxes back in page points."""
    back = lambda c, pad: (F.col(c) - fit[pad]) / fit["ratio"] / scale
    return dets.withColumns({"x0": back("x0", "pad_x"), "y0": back("y0", "pad_y"), "x1": back("x1", "pad_x"), "y1": back("y1", "pad_y")})


def ocr_words(lines: DataFrame, min_conf: float, block: int | Column = VISION_BLOCK, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """DET-8: ``keys, ord, points array<struct<x,y>>, text, conf, dx, dy, scale`` -> words. Unreadable confidences pass."""
    edge = lambda f, c, d: f(F.transform("points", lambda p: p[c])) / F.col("scale") + F.col(d)
    keep = F.coalesce(F.col("conf").cast("string").try_cast("double") >= min_conf, F.lit(True))
    return lines.where(keep).select(
        *keys, edge(F.array_min, "x", "dx").alias("x0"), edge(F.array_min, "y", "dy").alias("y0"), edge(F.array_max, "x", "dx").alias("x1"), edge(F.array_max, "y", "dy").alias("y1"),
        "text", (F.lit(block) + F.col("ord")).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("word"),
    )


def located_text(output: Column, width: Column, height: Column) -> Column:
    """DET-9: ``label<loc_n>...`` runs -> array of struct ``text, points`` (pixels at bin centres of 1000)."""
    run = F.lit(r"([^<]+)((?:<loc_\d+>){8,})")
    labels = F.transform(F.regexp_extract_all(output, run, F.lit(1)), lambda s: F.trim(s))
    places = F.transform(F.regexp_extract_all(output, run, F.lit(2)), lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"<loc_(\d+)>"), F.lit(1)), lambda n: n.cast("int")))
    point = lambda p, i: F.struct(((p[i] + 0.5) / 1000 * width).alias("x"), ((p[i + 1] + 0.5) / 1000 * height).alias("y"))
    pairs = F.zip_with(labels, places, lambda t, p: F.struct(t.alias("text"), F.array(*[point(p, i) for i in range(0, 8, 2)]).alias("points")))
    return F.filter(pairs, lambda r: r["text"] != "")


def reader_rows(result: Column) -> Column:
    """DET-9: JSON of an OCR-VL result -> array of struct ``text, box, conf``."""
    whole = F.from_json(result, "rec_texts array<string>, rec_boxes array<array<double>>, rec_scores array<double>, parsing_res_list array<struct<block_content:string, content:string, block_bbox:array<double>, bbox:array<double>>>")
    texts = F.transform(whole["rec_texts"], lambda t, i: F.struct(t.alias("text"), F.get(whole["rec_boxes"], i).alias("box"), F.coalesce(F.get(whole["rec_scores"], i), F.lit(1.0)).alias("conf")))
    blocks = F.transform(whole["parsing_res_list"], lambda b: F.struct(F.coalesce(b["block_content"], b["content"]).alias("text"), F.coalesce(b["block_bbox"], b["bbox"]).alias("box"), F.lit(1.0).alias("conf")))
    none = F.array().cast("array<struct<text:string,box:array<double>,conf:double>>")
    rows = F.when(F.size(whole["rec_texts"]) > 0, texts).otherwise(F.coalesce(blocks, none))
    return F.filter(rows, lambda r: (F.trim(r["text"]) != "") & r["box"].isNotNull())


def diameter_marks(paths: DataFrame) -> DataFrame:
    """DET-7: drawn paths (``items array<string>`` of 'c' and 'l', rect) that are diameter signs."""
    n = lambda kind: F.size(F.filter("items", lambda i: i == kind))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return paths.where((w > 0) & (h > 0) & (w <= 60) & (h <= 60) & (w / F.greatest(h, F.lit(1e-6))).between(0.6, 1.6) & (n("c") >= 3) & n("l").between(1, 2)).withColumn("symbol", F.lit("Ø"))


def by_page(keys: tuple[str, ...], **tables: tuple[DataFrame, str]) -> DataFrame:
    """A row for each page: ``keys`` and, by name, each table's rows as an array of the struct given, in no order.

    All tables are dealt out by page at once, and a page may miss in any of them.
    """
    parts = [df.select(*keys, F.struct(*re.findall(r"(\w+):", kind)).cast(kind).alias(name)) for name, (df, kind) in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(*[F.collect_list(name).alias(name) for name in tables])


def exploded_words(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Words of pages as rows."""
    return pages.select(*keys, F.explode("ws").alias("w")).select(*keys, *[f"w.{c}" for c in WORD_FIELDS])


def with_symbols(words: DataFrame, symbols: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """DET-6: ``symbols(keys, ord, x0..y1, symbol)`` go before the nearest number right of them, or become words."""
    return exploded_words(attached(by_page(keys, ws=(words, WORD_TYPE), ss=(symbols, SYMBOL_TYPE)), "ss"), keys)


def attached(pages: DataFrame, symbols: str) -> DataFrame:
    """DET-6 where a row is a page: ``ws``, its words as WORD_TYPE, with those of the array ``symbols`` (SYMBOL_TYPE).

    A symbol changes the word that the next may meet, so symbols fold over words: over those that fit one of them
    as they stand, as others never change, and those that symbols became.
    """
    folded = lambda c: F.translate(c, "".join(GLYPHS), "".join(GLYPHS.values()))
    numeric = lambda text: F.substring(text, 1, 1).isin(*NUMBER_STARTS)
    some = F.size(symbols) > 0

    def height(s: Column) -> Column:
        return F.greatest(s["y1"] - s["y0"], F.lit(2.0))

    def fits(w: Column, s: Column, number: Column) -> Column:
        h, gap = height(s), w["x0"] - s["x1"]
        level = F.abs((w["y0"] + w["y1"]) / 2 - (s["y0"] + s["y1"]) / 2) <= 0.7 * h
        return number & level & (gap >= -0.5 * h) & (gap <= 3.0 * h)

    def told(*values: Column) -> Column:
        return F.struct(*[v.alias(c) for c, v in zip((*WORD_ORDER, "number"), values, strict=True)])

    def attach(ws: Column, s: Column) -> Column:
        near = F.array_min(F.transform(ws, lambda w, i: F.when(fits(w, s, w["number"]), F.struct((w["x0"] - s["x1"]).alias("gap"), i.alias("i")))))
        has = lambda w: w["text"].startswith(s["symbol"]) | ((F.length(s["symbol"]) == 1) & (folded(F.substring(w["text"], 1, 1)) == folded(s["symbol"])))
        text = lambda w: F.concat(s["symbol"], w["text"])
        grown = lambda w: told(w["block"], w["line"], w["word"], F.least(s["x0"], w["x0"]), F.least(s["y0"], w["y0"]), F.greatest(s["x1"], w["x1"]), F.greatest(s["y1"], w["y1"]), text(w), numeric(text(w)))
        block = (F.lit(VISION_BLOCK) + F.size("__far") + F.size(ws)).cast("bigint")
        new = told(block, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), s["x0"], s["y0"], s["x1"], s["y1"], s["symbol"], numeric(s["symbol"]))
        put = lambda n: F.when(n.isNull(), F.array_append(ws, new)).otherwise(F.transform(ws, lambda w, i: F.when((i == n["i"]) & ~has(w), grown(w)).otherwise(w)))
        return F.transform(F.array(near), put)[0]  # the nearest is sought once

    rows = pages.withColumns({"ws": F.when(some, F.sort_array("ws")).otherwise(F.col("ws")), symbols: F.sort_array(symbols)})
    met = lambda w: F.exists(symbols, lambda s: fits(w, s, F.lit(True)))
    marked = F.transform("ws", lambda w: F.struct(w.alias("w"), F.coalesce(numeric(w["text"]) & met(w), F.lit(False)).alias("near")))
    rows = rows.withColumn("__marked", F.when(some, marked))
    near = F.transform(F.filter("__marked", lambda m: m["near"]), lambda m: told(*[m["w"][c] for c in WORD_ORDER], F.lit(True)))
    far = F.transform(F.filter("__marked", lambda m: ~m["near"]), lambda m: m["w"])
    rows = rows.withColumns({"__near": near, "__far": far})
    rows = rows.withColumn("__near", F.when(some, F.aggregate(symbols, F.col("__near").cast(f"array<{WORD_TYPE[:-1]},number:boolean>>"), attach)))
    out = F.concat("__far", F.transform("__near", lambda w: F.struct(*[w[c].alias(c) for c in WORD_ORDER])))
    return rows.withColumn("ws", F.when(some, out).otherwise(F.col("ws"))).drop(symbols, "__marked", "__near", "__far")


def kind_of(cls: Column) -> Column:
    """Kind of a region's class number, NULL if it is none."""
    return F.coalesce(*[F.when(cls == i, kind) for i, (kind, _, _) in enumerate(CATEGORIES.values())])


def admits(cls: Column, token: Column) -> Column:
    """FIL-10: whether a region's class may hold the sign; classes without a list hold none."""
    return F.coalesce(*[F.when(cls == i, F.trim(token).isin(*ADMITTED.get(c, ())) if ADMITTED.get(c) else F.lit(False)) for i, (_, _, c) in enumerate(CATEGORIES.values())], F.lit(False))


def boxed(regions: DataFrame) -> DataFrame:
    """Regions that may hold callouts, their edges as ``rx0`` to ``ry1``."""
    kept = regions.where(~F.coalesce(kind_of(F.col("cls")) == "meta", F.lit(False)))
    return kept.select("doc_id", "page", "region", "cls", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])


def centred_in(items: DataFrame, boxes: DataFrame, least_cell: float = 32.0) -> DataFrame:
    """FIL-5 for all regions of all pages: each pair of an item (``doc_id, page, x0..y1``) and a box that holds its centre.

    A spatial join by grids: a box goes to the grid whose cells are as large as it or up to twice,
    so it lies in four cells at most; an item goes to one cell of each grid that its page has.
    So a pair meets in one cell, and only there.
    """
    side = F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0"), F.lit(least_cell))
    level = F.ceil(F.log2(side / least_cell)).cast("int")
    wide = F.lit(least_cell) * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(c / wide)
    sized = boxes.where((F.col("rx1") >= F.col("rx0")) & (F.col("ry1") >= F.col("ry0"))).withColumn("level", level)
    reach = lambda a, b: F.explode(F.sequence(cell(F.col(a)), cell(F.col(b))))
    spread = sized.withColumn("gx", reach("rx0", "rx1")).withColumn("gy", reach("ry0", "ry1"))
    grids = sized.groupBy("doc_id", "page").agg(F.collect_set("level").alias("levels"))
    mid = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    points = items.join(grids, ["doc_id", "page"]).withColumn("level", F.explode("levels")).drop("levels")
    points = points.withColumns({"gx": cell(mid("x0", "x1")), "gy": cell(mid("y0", "y1"))})
    inside = mid("x0", "x1").between(F.col("rx0"), F.col("rx1")) & mid("y0", "y1").between(F.col("ry0"), F.col("ry1"))
    return points.join(spread, ["doc_id", "page", "level", "gx", "gy"]).where(inside).drop("level", "gx", "gy")


def centred_on(pages: DataFrame) -> DataFrame:
    """FIL-5 where a row is a page: each pair of one of its words ``ws`` and one of its ``boxes`` (``rx0..ry1`` and more) that holds its centre.

    Pairs are tested within their row, so nothing is dealt out; ``w`` and ``b`` hold the two.
    """
    rows = pages.withColumn("w", F.explode_outer("ws")).drop("ws").where("w IS NOT NULL")
    rows = rows.withColumn("b", F.explode_outer("boxes")).drop("boxes").where("b IS NOT NULL")
    held = lambda lo, hi: ((F.col(f"w.{lo}") + F.col(f"w.{hi}")) / 2).between(F.col(f"b.r{lo}"), F.col(f"b.r{hi}"))
    return rows.where(held("x0", "x1") & held("y0", "y1"))


REGION_KEYS = ("doc_id", "page", "region")


#: A line's number within its page: so many for each region.
REGION_LINES = 100_000


def hits_in(held: DataFrame, include_bare: bool) -> DataFrame:
    """Callouts of words that are told by region; ``cg``: the line's number, REGION_LINES for each region."""
    lines = merged_lines(with_keywords(normalized_words(gap_lines(held, keys=REGION_KEYS))), REGION_KEYS, MERGES)
    return parse_lines(lines.select("doc_id", "page", (F.col("region") * REGION_LINES + F.col("cg")).cast("int").alias("cg"), "toks"), include_bare)


def with_region(hits: DataFrame) -> DataFrame:
    return hits.withColumn("region", F.floor(F.col("cg") / REGION_LINES))


def kept_once(hits: DataFrame, boxes: DataFrame) -> DataFrame:
    """LIN-11 over a page's regions; then ``cg`` is 1000 for each region, and within a table its line."""
    table = list(CATEGORIES).index("hole_table")
    rows = with_region(dedup_hits(hits)).join(boxes.select(*REGION_KEYS, "cls"), list(REGION_KEYS))
    band = F.col("region") * 1000 + F.when(F.col("cls") == table, F.col("cg") % REGION_LINES).otherwise(0)
    return rows.withColumn("cg", band.cast("int")).drop("cls")


def region_hits(words: DataFrame, regions: DataFrame, symbols: DataFrame | None = None, include_bare: bool = False) -> DataFrame:
    """DET-10: ``regions(doc_id, page, region, x0..y1, cls)``: callouts of the words whose centre each holds.

    Meta regions give none. Regions with fewer than two words take the ``symbols`` that their
    class admits. ``cg`` is 1000 for each region, and a table's lines count within it. Equal
    hits near each other stay once for a page. Pages without hits have no rows: a fallback.
    """
    boxes = boxed(regions)
    held = centred_in(words, boxes).select(*REGION_KEYS, *WORD_FIELDS)
    if symbols is not None:
        texts = held.where(F.trim("text") != "").groupBy(*REGION_KEYS).agg(F.count("*").alias("n_text"))
        poor = boxes.join(texts, list(REGION_KEYS), "left").where(F.coalesce("n_text", F.lit(0)) < 2).drop("n_text")
        held = with_symbols(held, admitted(symbols, poor), REGION_KEYS)
    return kept_once(hits_in(held, include_bare), boxes).drop("region")


def admitted(symbols: DataFrame, boxes: DataFrame) -> DataFrame:
    """Symbols by the region that holds their centre and, if it has a class, admits them."""
    marks = centred_in(symbols, boxes).where(kind_of(F.col("cls")).isNull() | admits(F.col("cls"), F.col("symbol")))
    return marks.select(*REGION_KEYS, "ord", "x0", "y0", "x1", "y1", "symbol")


#: What a reader of region images gives: a line of text each, in pixels of a crop that begins at ``dx, dy`` of the page.
READ_SCHEMA = "doc_id string, page int, region long, ord long, points array<struct<x:double,y:double>>, text string, conf double, dx double, dy double, scale double"
#: First block numbers of what readers read, and those of a region. Fixed values.
READ_BLOCKS, REGION_BLOCKS = {"ocr": VISION_BLOCK + 5000, "vlm": VISION_BLOCK + 7000}, 100


def captured_regions(regions: DataFrame, capture: DataFrame | None) -> DataFrame:
    """Regions that touch their page's capture rectangle ``(doc_id, page, cx0..cy1)``, numbered anew; without one, all of the page."""
    if capture is None:
        return regions
    touching = ~((F.col("x1") < F.col("cx0")) | (F.col("x0") > F.col("cx1")) | (F.col("y1") < F.col("cy0")) | (F.col("y0") > F.col("cy1")))
    kept = regions.join(capture, ["doc_id", "page"], "left").where(F.col("cx0").isNull() | touching)
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("region")) - 1
    return kept.withColumn("region", number.cast("long")).select(*regions.columns)


def routes(words_held: DataFrame, boxes: DataFrame, images: DataFrame, readers: dict[str, Reader], force_vlm: bool) -> DataFrame:
    """``boxes`` with ``n_text``, ``image``, ``scale`` and the first ``reader``: text for two words or more, else VLM, else OCR, else text."""
    texts = words_held.where(F.trim("text") != "").groupBy(*REGION_KEYS).agg(F.count("*").alias("n_text"))
    rows = boxes.join(texts, list(REGION_KEYS), "left").withColumn("n_text", F.coalesce("n_text", F.lit(0)))
    rows = rows.join(images, ["doc_id", "page"], "left")
    seen = F.col("image").isNotNull()
    rich = (F.col("n_text") >= 2) & ~F.lit(force_vlm and "vlm" in readers)
    route = F.when(rich, "text").when(seen & F.lit("vlm" in readers), "vlm").when(seen & F.lit("ocr" in readers), "ocr").otherwise("text")
    return rows.withColumn("reader", route)


def routed_hits(words: DataFrame, regions: DataFrame, images: DataFrame, readers: dict[str, Reader], *, capture: DataFrame | None = None, symbols: DataFrame | None = None, include_bare: bool = False, force_vlm: bool = False, inject_vlm: bool = True, min_conf: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """DET-10: callouts of regions, each read by the reader that fits: ``(reads, hits)``.

    ``images(doc_id, page, image, scale)``; ``readers``: 'vlm' and 'ocr', as far as at hand, which
    take rows of ``REGION_KEYS, rx0..ry1, image, scale`` and give READ_SCHEMA. A region with two words or
    more is read from the text layer (unless ``force_vlm``), else by the VLM or OCR if its page has
    an image. Where the VLM reads nothing, the region's own word, if it has one, is taken. ``symbols`` go to regions
    that were not read from the text layer. Containers keep what touches the ``capture``
    rectangle. ``reads``: ``REGION_KEYS, cls, reader``; ``hits``: as ``region_hits`` and ``region``.
    """
    boxes = boxed(captured_regions(regions, capture))
    held = centred_in(words, boxes).select(*REGION_KEYS, *WORD_FIELDS)
    rows = routes(held, boxes, images, readers, force_vlm)
    asked = lambda name: rows.where(F.col("reader") == name).select(*REGION_KEYS, "rx0", "ry0", "rx1", "ry1", "image", "scale")
    read = {}
    for name in [n for n in READ_BLOCKS if n in readers]:
        first = F.lit(READ_BLOCKS[name]) + F.col("region") * REGION_BLOCKS
        told = read_with(asked(name), readers[name], READ_SCHEMA)
        read[name] = ocr_words(told, min_conf if name == "ocr" else float("-inf"), first, REGION_KEYS)
    reads = rows.select(*REGION_KEYS, "cls", "n_text", "reader")
    if "vlm" in read:
        some = read["vlm"].select(*REGION_KEYS).distinct().withColumn("some", F.lit(True))
        own = (F.col("reader") == "vlm") & F.col("some").isNull() & (F.col("n_text") > 0)
        reads = reads.join(some, list(REGION_KEYS), "left").withColumn("reader", F.when(own, "text").otherwise(F.col("reader"))).drop("some")
    reads = reads.drop("n_text")
    taken = held.join(reads.where("reader = 'text'"), list(REGION_KEYS), "left_semi")
    for part in read.values():
        taken = taken.unionByName(part.select(*taken.columns))
    if symbols is not None:
        off_page = F.col("reader").isin(*(["ocr", "vlm"] if inject_vlm else ["ocr"]))
        marks = admitted(symbols, boxes.join(reads.where(off_page).select(*REGION_KEYS), list(REGION_KEYS), "left_semi"))
        taken = with_symbols(taken, marks, REGION_KEYS)
    hits = hits_in(taken, include_bare)
    if capture is not None:
        container = boxes.where(kind_of(F.col("cls")) == "container").select(*REGION_KEYS, F.lit(True).alias("container"))
        r = F.col("rect")
        apart = (r["x1"] < F.col("cx0")) | (r["x0"] > F.col("cx1")) | (r["y1"] < F.col("cy0")) | (r["y0"] > F.col("cy1"))
        cut = with_region(hits).join(container, list(REGION_KEYS), "left").join(capture, ["doc_id", "page"], "left")
        hits = cut.where(F.col("container").isNull() | r.isNull() | ~F.coalesce(apart, F.lit(False))).select(*hits.columns)
    return reads, kept_once(hits, boxes)


def meta_at(regions: DataFrame, points: DataFrame) -> DataFrame:
    """DET-11: ``points(doc_id, page, id, px, py)`` -> ``id, meta``: the smallest meta region there, unless a callout's region is too."""
    hit = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    at = points.join(regions, ["doc_id", "page"], "left").withColumn("kind", F.when(hit, kind_of(F.col("cls"))))
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    meta = F.col("kind") == "meta"
    smallest = F.min(F.when(meta, F.struct(area.alias("area"), F.col("region"), F.try_element_at(names, F.col("cls") + 1).alias("cls"))))
    return at.groupBy("doc_id", "page", "id").agg(smallest.alias("m"), F.coalesce(F.bool_or(~meta), F.lit(False)).alias("busy")).select("doc_id", "page", "id", F.when(~F.col("busy"), F.col("m.cls")).alias("meta"))


def augmented(words: DataFrame, marks: DataFrame, ocr: DataFrame, symbols: DataFrame) -> DataFrame:
    """DET-12: drawn signs, then OCR words of sparse pages, then detected symbols."""
    keys = ("doc_id", "page")
    pages = by_page(keys, ws=(words, WORD_TYPE), marks=(marks, SYMBOL_TYPE), ocr=(ocr, WORD_TYPE), ss=(symbols, SYMBOL_TYPE))
    return exploded_words(augmented_pages(pages), keys)


def augmented_pages(pages: DataFrame) -> DataFrame:
    """DET-12 where a row is a page: its words ``ws``, and the arrays ``marks``, ``ocr`` (words) and ``ss``."""
    first = attached(pages, "marks")
    sparse = F.size(F.filter("ws", lambda w: F.trim(w["text"]) != "")) < 4
    return attached(first.withColumn("ws", F.when(sparse, F.concat("ws", "ocr")).otherwise(F.col("ws"))).drop("ocr"), "ss")
