"""Words of markup: blocks, lines, places, turned pages, and pages that hold nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlark.sources import markup

PAGE = "doc_id long, page int, html string, rotation int, width double, height double"


def test_blocks_lines_and_signs(spark):
    html = "<html><head><title>no</title></head><body><!-- <p>no</p> --><p>one  <b>two</b>thr&lt;ee<br/>fo&amp;lt;ur\n five<script>var t='</p>'; no()</script></p><STYLE>p{}</STYLE><div><span> </span></div><ul><li>six</ul> a < b</body></html>"
    pages = spark.createDataFrame([(1, 0, html, None, 0.0, 0.0), (2, 0, None, 90, 1.0, 1.0), (3, 0, "<p> <br>", 90, 1.0, 1.0), (4, 0, "<p" + "x" * 100_000, 0, 1.0, 1.0), (5, 0, "", None, None, None)], PAGE).withColumn("text", F.lit("x"))
    words = markup.page_words(pages).orderBy("doc_id", "block", "line", "word").collect()
    assert [(r["block"], r["line"], r["word"], r["text"]) for r in words if r["doc_id"] == 1] == [
        (0, 0, 0, "one"), (0, 0, 1, "twothr<ee"), (0, 1, 0, "fo&lt;ur"), (0, 1, 1, "five"), (1, 0, 0, "six"), (2, 0, 0, "a"), (2, 0, 1, "<"), (2, 0, 2, "b")
    ]
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in words[:4]] == [(0.0, 0.0, 18.0, 10.0), (24.0, 0.0, 78.0, 10.0), (0.0, 12.0, 48.0, 22.0), (54.0, 12.0, 78.0, 22.0)]
    assert {r["doc_id"] for r in words} == {1, 4}, "pages without text have no words; what never ends as a tag is a word"


def test_turned_pages(spark):
    said = "<p>ab cd"
    pages = spark.createDataFrame([(i, 0, said, turn, 600.0, 800.0) for i, turn in enumerate((0, 90, 180, 270, -90, 45, 450, None))], PAGE)
    got = {r["doc_id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in markup.displayed(markup.page_words(pages), pages).where("word = 1").collect()}
    plain, right, half, left = (18.0, 0.0, 30.0, 10.0), (790.0, 18.0, 800.0, 30.0), (570.0, 790.0, 582.0, 800.0), (0.0, 570.0, 10.0, 582.0)
    assert got == {0: plain, 1: right, 2: half, 3: left, 4: left, 5: plain, 6: right, 7: plain}
