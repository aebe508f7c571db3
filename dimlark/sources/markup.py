"""Placed words of pages that come as markup, in displayed coordinates.

Tags that open or close a block part blocks, line breaks part lines, and white space parts words;
scripts, styles, heads and comments are left out. A word's place follows from its line and the
characters before it, as on a page of fixed type. All of it is column work and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is no text, and what parts blocks and lines; patterns that Java and RE2 read alike.
UNSEEN = (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>")
BLOCK_TAG = r"(?i)</?(?:p|div|ul|ol|li|h[1-6]|article|section|nav|header|footer|table|tr|body|html)\b[^>]*>"
BREAK_TAG, OTHER_TAG = r"(?i)<br\b[^>]*>", r"<[/!?A-Za-z][^>]*>"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
CHAR, LINE, LETTERING = 6.0, 12.0, 10.0


def blocks_of(html: Column) -> Column:
    """Blocks of text as arrays of their lines, words parted by one space; blank ones left out."""
    text = F.coalesce(html, F.lit(""))
    for pattern in UNSEEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " ")
    for pattern, mark in ((BLOCK_TAG, "\f"), (BREAK_TAG, "\n"), (OTHER_TAG, "")):
        text = F.regexp_replace(text, pattern, mark)
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    tidy = lambda s: F.trim(F.regexp_replace(s, " +", " "))
    lines = F.transform(F.split(text, "\f", -1), lambda b: F.filter(F.transform(F.split(b, "\n", -1), tidy), lambda s: s != ""))
    return F.filter(lines, lambda b: F.size(b) > 0)


def page_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """IO-1: ``pages(doc_id, page, html)`` -> words as a text layer gives them, before any rotation.

    A page that is NULL or holds no text has no words.
    """
    rows = pages.select("doc_id", "page", F.explode_outer(F.flatten(F.transform(blocks_of(F.col(html)), lambda b, i: F.transform(b, lambda s, j: F.struct(i.alias("block"), j.alias("line"), s.alias("s")))))).alias("l"))
    rows = rows.where("l IS NOT NULL")
    above = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("l.block", "l.line")) - 1
    rows = rows.withColumn("__row", above)
    words = rows.select("doc_id", "page", "__row", "l.block", "l.line", F.posexplode(F.split("l.s", " ", -1)).alias("word", "text"))
    line = Window.partitionBy("doc_id", "page", "__row").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    x0 = F.coalesce(F.sum(F.length("text") + 1).over(line), F.lit(0)) * CHAR
    y0 = F.col("__row") * LINE
    return words.select(
        "doc_id", "page", x0.alias("x0"), y0.alias("y0"), (x0 + F.length("text") * CHAR).alias("x1"), (y0 + LETTERING).alias("y1"), "text", *[F.col(c).cast("long").alias(c) for c in ("block", "line", "word")]
    )


def displayed(words: DataFrame, pages: DataFrame) -> DataFrame:
    """IO-1: ``words`` as pages show them: ``pages(doc_id, page, rotation, width, height)``, sizes before rotation.

    Rotations are clockwise; what is no multiple of 90, or unknown, counts as none.
    """
    turn = F.coalesce(F.pmod(F.col("rotation"), F.lit(360)), F.lit(0))
    w, h = F.col("width"), F.col("height")
    rows = words.join(pages.select("doc_id", "page", "rotation", "width", "height"), ["doc_id", "page"], "left")
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    pick = lambda plain, quarter, half, three: F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(plain)
    box = {
        "x0": pick(c["x0"], h - c["y1"], w - c["x1"], c["y0"]),
        "y0": pick(c["y0"], c["x0"], h - c["y1"], w - c["x1"]),
        "x1": pick(c["x1"], h - c["y0"], w - c["x0"], c["y1"]),
        "y1": pick(c["y1"], c["x1"], h - c["y0"], w - c["x0"]),
    }
    return rows.select(*[box[k].alias(k) if k in box else k for k in words.columns])
