"""Goldens, written by hand from the semantics, and plain loops for the greedy operators."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from dimlark.functions import pyfmt, standards, text, verdict
from dimlark.operators import detect, ledger, lines, rows, scan, spatial
from dimlark.schema import EngineConf
from dimlark.sources import labels, session, sheet
from dimlark.streaming import measurements

WORDS = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block long, line long, word long"


def values(spark, column, cases, schema="x string"):
    df = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], "i int, " + schema)
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_python_numbers(spark):
    xs = [0.0, -0.0, 1.0, 0.05, 100000.0, 123456.0, 1234567.0, 1e-4, 1.5e-5, 2.5, -3.125, 1e20, 0.1 + 0.2, None, 99999.94, 1e6]
    assert values(spark, pyfmt.py_g(F.col("x")), xs, "x double") == [None if x is None else "%g" % (x + 0.0 if x else 0.0) for x in xs]
    assert values(spark, pyfmt.py_g_signed(F.col("x")), [0.5, -0.25, 0.0], "x double") == ["+0.5", "-0.25", "+0"]
    assert values(spark, pyfmt.fnum(F.col("x")), ["1,5", " 2 ", "", None, "abc", "1d", "nan", ".5", "1e3", "1_0"]) == [1.5, 2.0, None, None, None, None, None, 0.5, 1000.0, None]
    assert values(spark, pyfmt.base_of(F.col("x")), ["7", "7a", "12zz", "", "A1", "?"]) == [7, 7, 12, 0, None, None]
    assert values(spark, pyfmt.dp_of_text(F.col("x")), ["10.0", "1,25", "7", "", None]) == [1, 2, 0, None, None]


def test_general_tolerances(spark):
    got = values(spark, text.general_tols(F.col("x")), ["TWO PLACE DECIMAL ±.01 three place decimal: .005 .XX ±.9 .XXXX ±.0005 ANGULAR ±1", ".X ±0 .X ±.2 .X ±.3", "", None])
    assert got == [{"2": 0.01, "3": 0.005, "4": 0.0005, "ang": 1.0}, {"1": 0.2}, {}, {}]


def test_tolerance_strings(spark):
    cases = {"±0.1": (0.1, None, None), "+0.2/-0.1": (None, 0.2, -0.1), "0/-0.1": (None, 0.0, -0.1), "+0.1": (None, 0.1, 0.0), "-0.1": (None, 0.0, -0.1), "BASIC": (None,) * 3, "REF": (None,) * 3, "abc": (None,) * 3, "1,5": (None,) * 3, "±1,5°": (1.5, None, None)}
    got = values(spark, text.parse_tol_string(F.col("x")), list(cases))
    assert [tuple(g) for g in got] == list(cases.values())


SCANS = {
    "Ø10 H7": [("FIT", None, "Ø10 H7", "H7")],
    "4X Ø 5.5 THRU": [("DIAMETER", None, "4X Ø5.5", None)],
    "M6x1 - 6H": [("THREAD", None, "M6x1 - 6H", None)],
    "1/4-20 UNC": [("THREAD", None, "1/4-20 UNC", None)],
    "12,5 ±0.1": [("LINEAR", None, "12,5", "±0.1")],
    "R5, R5": [("RADIUS", None, "R5", None)],
    "R5 R5": [("FIT", None, "5 R5", "R5")],
    "2x45°": [("CHAMFER", None, "2x45°", None)],
    "C2": [("CHAMFER", None, "C2", None)],
    "⌖ Ø0.1 (M) A B": [("GDT", "POSITION", "POSITION Ø0.1 M", "0.1")],
    "▱ 0.05 Ⓛ": [("GDT", "FLATNESS", "FLATNESS 0.05 L", "0.05")],
    "⟂ 0.2 ∥ 0.3": [("GDT", "PARALLELISM", "PARALLELISM 0.3", "0.3"), ("GDT", "PERPENDICULARITY", "PERPENDICULARITY 0.2", "0.2")],
    "⌓0.4": [("GDT", "PROFILE", "PROFILE 0.4", "0.4")],
    "STRAIGHTNESS 0.02": [("GDT", "STRAIGHTNESS", "STRAIGHTNESS 0.02", "0.02")],
    "◯ 0.03": [("GDT", "CIRCULARITY", "CIRCULARITY 0.03", "0.03")],
    "ROUNDNESS 0.04": [("GDT", "CIRCULARITY", "CIRCULARITY 0.04", "0.04")],
    "⌭ 0.01": [("GDT", "CYLINDRICITY", "CYLINDRICITY 0.01", "0.01")],
    "∠ 0.5": [("GDT", "ANGULARITY", "ANGULARITY 0.5", "0.5")],
    "↗ 0.06": [("GDT", "RUNOUT", "RUNOUT 0.06", "0.06")],
    "TIR 0.07": [("GDT", "RUNOUT", "RUNOUT 0.07", "0.07")],
    "◎ 0.08": [("GDT", "CONCENTRICITY", "CONCENTRICITY 0.08", "0.08")],
    "Ra 1.6": [("SURFACE", None, "Ra 1.6", None)],
    "CBORE Ø10 DEEP 5": [("DIAMETER", "CBORE", "CBORE Ø10", None), ("DEPTH", None, "DEEP 5", None)],
    "C'SINK Ø10 x 90°": [("DIAMETER", "CSINK", "CSINK Ø10 X90°", None)],
    "90° ±1°": [("ANGLE", None, "90°", "±1")],
    "[25] (30) 4.5 +0.05": [("LINEAR", "BASIC", "25", "BASIC"), ("LINEAR", "REF", "30", "REF"), ("LINEAR", None, "4.5", "+0.05")],
    "10 +0.2/-0.1": [("LINEAR", None, "10", "+0.2/-0.1")],
    "25\n+0.1\n-0.2": [("LINEAR", None, "25", "+0.1/-0.2")],
    "30 +0.1\n-0.2": [("LINEAR", None, "30", "+0.1/-0.2")],
    "4X\n.25": [],
    "Głęb. 12": [("DEPTH", None, "DEEP 12", None)],
    "2 OTWORY Ø3 przelot": [("DIAMETER", None, "2X Ø3", None)],
    "20 ZZ3": [],
    "": [],
}


def test_scans(spark):
    df = spark.createDataFrame(list(enumerate(SCANS)), "id int, text string")
    got = {}
    for r in scan.scan_parse(df.withColumn("text", text.normalized(F.col("text"))), F.col("text"), ("id",)).orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append((r["tp"], r["sb"], r["v"], r["t"]))
        assert (r["thru"] or False) == (r["tp"] == "DIAMETER" and r["sb"] is None and ("THRU" in list(SCANS)[r["id"]] or "przelot" in list(SCANS)[r["id"]]))
    assert [got.get(i, []) for i in range(len(SCANS))] == list(SCANS.values())


def test_claimed_spans_are_apart(spark):
    rng = random.Random(5)
    parts = ["Ø10", "H7", "±0.1", "R5", "2x45°", "(30)", "[25]", "+0.1", "/-0.2", "4X ", "CBORE ", "DEEP ", "M6", " ", "1/4-20", "Ra 3.2", "90°", "C2"]
    df = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(8))) for i in range(120)], "id int, text string")
    spans = {}
    for r in scan.scan_parse(df, F.col("text"), ("id",)).collect():
        spans.setdefault(r["id"], []).append((r["start"], r["end"]))
    for own in spans.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def placed(*words):
    """(text, x, y, block, line, word) -> rows, six points to a letter, ten high."""
    return [("d", 0, float(x), float(y), float(x + 6 * len(t)), float(y + 10), t, b, n, w) for t, x, y, b, n, w in words]


PLACED = placed(
    ("25", 0, 100, 0, 0, 0), ("+0.1", 20, 94, 1, 0, 0), ("-0.2", 20, 106, 2, 0, 0), ("Ø10", 200, 100, 3, 0, 0), ("THROUGH", 200, 112, 3, 1, 0), ("30", 400, 100, 4, 0, 0), ("H7", 420, 100, 5, 0, 0),
    ("4X", 500, 100, 6, 0, 0), ("Ø5", 500, 112, 6, 1, 0), ("12", 600, 100, 7, 0, 0), ("40", 900, 100, 7, 0, 1), ("10", 0, 300, 8, 0, 0), (".", 13, 300, 8, 0, 1), ("5", 20, 300, 8, 0, 2), ("±0.1", 30, 300, 8, 0, 3),
    ("50", 0, 500, 9, 0, 0), ("+0.3", 14, 500, 9, 0, 1), ("-0.1", 30, 512, 10, 0, 0), ("DEEP", 300, 500, 11, 0, 0), ("0", 300, 512, 12, 0, 0), ("1999", 700, 700, 13, 0, 0),
)


def test_placed_words(spark):
    df = spark.createDataFrame(PLACED, WORDS)
    texts = {r["t"] for r in lines.callout_lines(df).select(F.array_join(F.transform("toks", lambda t: t["t"]), " ").alias("t")).collect()}
    assert {"25 +0.1/-0.2", "Ø10 THRU", "30 H7", "4X Ø5", "12", "40", "10.5 ±0.1", "50 +0.3/-0.1", "DEEP 0"} <= texts
    hits = lines.scan_words(df, True).collect()
    got = {(h["tp"], h["v"], h["t"]) for h in hits}
    assert {("LINEAR", "25", "+0.1/-0.2"), ("DIAMETER", "Ø10", None), ("FIT", "30 H7", "H7"), ("DIAMETER", "4X Ø5", None), ("LINEAR", "12", None), ("LINEAR", "10.5", "±0.1"), ("LINEAR", "50", "+0.3/-0.1")} <= got
    assert ("LINEAR", "1999", None) not in got and ("LINEAR", "0", None) not in got
    rect = next(h["rect"] for h in hits if h["v"] == "25")
    assert (rect["x0"], rect["y0"], rect["x1"], rect["y1"]) == (0.0, 94.0, 44.0, 116.0)


def test_keywords(spark):
    cases = {"POGŁĘBIENIE WALCOWE 5": "CBORE 5", "DP 5": "DEEP 5", "DP x": "DP x", "SF Ø5": "CBORE Ø5", "Durch.": "THRU", "radius 4": "R 4", "// 0.1": "PARALLELISM 0.1"}
    df = spark.createDataFrame([("d", 0, float(40 * w), 0.0, float(40 * w + 30), 10.0, t, i, 0, w) for i, c in enumerate(cases) for w, t in enumerate(c.split())], WORDS)
    out = lines.with_keywords(lines.normalized_words(lines.lines_of_words(df))).select("block", F.array_join(F.transform("toks", lambda t: t["t"]), " ").alias("t")).orderBy("block").collect()
    assert [r["t"] for r in out] == list(cases.values())


def test_dedup_is_greedy(spark):
    at = lambda x: (x, 0.0, x, 0.0)
    hits = [("d", 0, i, 0, "LINEAR", None, "5", None, "5", None, at(x)) for i, x in enumerate((0.0, 8.0, 16.0))] + [("d", 0, 3, 0, "LINEAR", None, "6", None, "6", None, None), ("d", 0, 4, 0, "LINEAR", None, "6", None, "6", None, at(99.0))]
    df = spark.createDataFrame(hits, "doc_id string, page int, cg int, i int, tp string, sb string, v string, t string, raw string, thru boolean, rect struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted(r["cg"] for r in scan.dedup_hits(df).collect()) == [0, 2, 3]


def test_suppression_against_a_loop(spark):
    rng = random.Random(2)
    boxes = [(i, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(5, 30), rng.uniform(5, 30), round(rng.random(), 2), rng.randint(0, 2)) for i in range(150)]
    df = spark.createDataFrame([("d", 0, i, x, y, x + w, y + h, c, k) for i, x, y, w, h, c, k in boxes], "doc_id string, page int, ord long, x0 double, y0 double, x1 double, y1 double, conf double, cls int")

    def iou(a, b):
        iw, ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        inter = max(iw, 0) * max(ih, 0)
        return inter / (a[3] * a[4] + b[3] * b[4] - inter)

    kept = []
    for b in sorted(boxes, key=lambda b: -b[5]):
        if all(k[6] != b[6] or iou(b, k) < 0.45 for k in kept):
            kept.append(b)
    assert sorted(r["ord"] for r in detect.suppressed(df).collect()) == sorted(b[0] for b in kept)


def test_symbols_and_regions(spark):
    df = spark.createDataFrame(placed(("10", 100, 100, 0, 0, 0), ("Ø20", 100, 200, 1, 0, 0), ("alone", 100, 300, 2, 0, 0)), WORDS)
    marks = spark.createDataFrame([("d", 0, i, 80.0, y, 95.0, y + 10, "Ø") for i, y in enumerate((100.0, 200.0, 300.0, 500.0))], "doc_id string, page int, ord long, x0 double, y0 double, x1 double, y1 double, symbol string")
    got = detect.with_symbols(df, marks).collect()
    assert sorted(r["text"] for r in got) == ["alone", "Ø", "Ø", "Ø10", "Ø20"] and sum(r["block"] >= detect.VISION_BLOCK for r in got) == 2
    regions = spark.createDataFrame([("d", 0, 0, 0.0, 0.0, 1000.0, 150.0, 0), ("d", 0, 1, 0.0, 150.0, 1000.0, 600.0, 7)], "doc_id string, page int, region long, x0 double, y0 double, x1 double, y1 double, cls int")
    hits = detect.region_hits(df, regions, marks, True).collect()
    assert [(h["tp"], h["v"], h["cg"]) for h in hits] == [("DIAMETER", "Ø10", 0)]
    points = spark.createDataFrame([("d", 0, 1, 5.0, 500.0), ("d", 0, 2, 5.0, 100.0), ("d", 0, 3, -5.0, 0.0)], "doc_id string, page int, id int, px double, py double")
    assert {r["id"]: r["meta"] for r in detect.meta_at(regions, points).collect()} == {1: "note", 2: None, 3: None}


def test_iso_286_edges(spark):
    cases = [(3.0, "H7"), (3.0001, "H7"), (0.0, "H7"), (None, "H7"), (500.0, "h6"), (500.1, "h6"), (280.0, "M6"), (315.1, "M6"), (10.0, "K9"), (10.0, "N9"), (10.0, "c11"), (10.0, "JS9"), (10.0, "P7"), (60.0, "r6"), (10.0, "x"), (20.0, " g6 ")]
    want = [(0.01, 0.0), (0.012, 0.0), None, None, (0.0, -0.04), None, (-0.009, -0.041), (-0.010, -0.046), None, (0.0, -0.036), None, (0.018, -0.018), (-0.009, -0.024), (0.060, 0.041), None, (-0.007, -0.02)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d double, code string")
    joined = [None if r["upper"] is None else (r["upper"], r["lower"]) for r in standards.with_fit_limits(df, F.col("d"), F.col("code")).orderBy("i").collect()]
    assert joined == [w and pytest.approx(w) for w in want]
    codes = tuple({c.strip() for _, c in cases})
    by_case = df.select("i", standards.fit_limits(F.col("d"), F.col("code"), codes).alias("v")).orderBy("i").collect()
    assert [None if r["v"] is None else tuple(r["v"]) for r in by_case] == joined


def test_iso_2768_edges(spark):
    cases = [(0.49, "m", None), (0.5, "m", 0.1), (3.0, "m", 0.1), (6.0, "c", 0.3), (30.0, "m", 0.2), (4000.0, "f", None), (3.0, "v", None), (3.1, "v", 0.5), (10.0, "x", None), (4000.1, "m", None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, n double, cls string")
    assert [r["v"] for r in df.select("i", standards.general_tol("linear", F.col("n"), F.col("cls")).alias("v")).orderBy("i").collect()] == [c[2] for c in cases]
    assert [r["tol"] for r in standards.with_general_tol(df, "linear", F.col("n"), F.col("cls")).orderBy("i").collect()] == [c[2] for c in cases]


def test_the_two_verdicts_disagree(spark):
    cases = [  # nominal, sym, max, min, offset, pin, measured -> out (application), sheet
        ((10.0, 0.1, None, None, None, None, "10,1"), False, "PASS"),
        ((10.0, 0.1, None, None, None, 0.2, "10.1"), False, "FAIL"),
        ((10.0, 0.1, 0.5, -0.5, None, None, "10.3"), True, "PASS"),
        ((10.0, None, 0.1, None, None, None, "11"), False, ""),
        ((10.0, 0.1, None, None, None, None, "NO-GO"), True, ""),
        ((10.0, 0.1, None, None, None, None, "go"), False, "PASS"),
        ((10.0, 0.1, None, None, None, None, "NIE"), True, "FAIL"),
        ((10.0, -0.1, None, None, None, None, "10.05"), False, "PASS"),
        ((10.0, 0.1, None, None, None, None, ""), False, ""),
        ((None, 0.1, None, None, None, None, "5"), False, ""),
        ((10.0, None, -0.1, 0.2, None, None, "10.15"), False, "PASS"),
        ((10.0, 0.1, None, 0.05, None, None, "10.02"), False, "FAIL"),
    ]
    cols = [F.col(c) for c in ("nominal", "sym", "mx", "mn", "off", "pin", "m")]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, nominal double, sym double, mx double, mn double, off double, pin double, m string")
    got = df.select("i", verdict.out_of_tol(*cols[:4], cols[6]).alias("out"), verdict.sheet_verdict(*cols).alias("sheet")).orderBy("i").collect()
    assert [(r["out"], r["sheet"]) for r in got] == [(c[1], c[2]) for c in cases]


LEDGER = "doc_id string, seq long, uid long, page int, bubble string, type string, `group` string, measured string"


def test_numbering(spark):
    many = [("d", i, 1, 0 if i else 2, None, "dim", "LWH", None) for i in range(27)] + [("d", 30, 2, 1, None, "dim", "LWH", None)]
    df = spark.createDataFrame(many, LEDGER)
    out = ledger.renumber(df)
    label = {r["seq"]: r["bubble"] for r in out.collect()}
    assert label[30] == "1" and label[0] == "2a" and label[25] == "2z" and label[26] == "2a"
    assert {r["seq"]: r["bubble"] for r in ledger.renumber(out).collect()} == label
    assert {r["seq"]: r["bubble"] for r in ledger.renumber(df.repartition(7)).collect()} == label
    legacy = spark.createDataFrame([("d", 1, None, 0, "3", "attr", "finish / x", None), ("d", 2, None, 0, "3a", "dim", "", None), ("d", 3, 5, 0, "3", "attr", "other", None), ("d", 4, None, 1, "3", "dim", "", None)], LEDGER)
    got = ledger.migrated(legacy).orderBy("seq").collect()
    assert [r["uid"] for r in got] == [6, 6, 5, 7] and [r["type"] for r in got] == ["finish / wykończenie", "dim", "GD&T", "dim"]


def test_expansion(spark):
    base = {"type": "hole / otwór", "group": "g", "nominal": 5.0, "tol_sym": None, "tol_max": None, "tol_min": None, "pin": None, "offset": None, "measured": None, "tier": ""}
    cases = [base | {"id": 0, "feature": "4X Ø5"}, base | {"id": 1, "feature": "30X Ø5"}, base | {"id": 2, "feature": "2X CBORE Ø5"}, base | {"id": 3, "feature": "Ø5", "pin": 4.0}, base | {"id": 4, "feature": "5", "type": "dim"}]
    schema = "id int, type string, `group` string, feature string, nominal double, tol_sym double, tol_max double, tol_min double, pin double, offset double, measured string, tier string"
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cases], schema)
    got = rows.expanded(df).groupBy("id").agg(F.count("*").alias("n"), F.max("pin").alias("pin"), F.min_by("feature", "part").alias("f")).orderBy("id").collect()
    assert [(r["n"], r["pin"], r["f"]) for r in got] == [(12, 5.0, "Ø5"), (78, 5.0, "Ø5"), (2, None, "CBORE Ø5"), (3, 4.0, "Ø5"), (1, None, "5")]
    single = rows.expanded(df, EngineConf(hole_position_rows=False), F.lit(False)).collect()
    assert len(single) == 5 and {r["feature"] for r in single} == {c["feature"] for c in cases}


def test_gage_fallback(spark):
    conf = EngineConf(enabled_gages=("caliper", "height gauge"))
    args = [F.col(c) for c in ("t", "g", "s", "mx", "mn")]
    df = [("thread / gwint", "", None, None, None), ("dim", "GD&T", None, None, None), ("dim", "", 0.02, None, None), ("dim", "", -5.0, None, None), ("hole / otwór", "", None, 0.5, 0.0)]
    schema = "t string, g string, s double, mx double, mn double"
    assert values(spark, rows.suggest_gage(*args), df, schema) == ["GO gauge", "CMM", "micrometer", "CMM", "pin / bore gauge"]
    assert values(spark, rows.suggest_gage(*args, conf), df, schema) == ["screw test / wkręt", "height gauge", "caliper", "height gauge", "caliper"]


def test_balloons_keep_apart(spark):
    rng = random.Random(4)
    none = None
    anchors = spark.createDataFrame([("d", 0, i, rng.uniform(50, 550), rng.uniform(50, 550), none, none, none, none) for i in range(25)], "doc_id string, page int, ord long, ax double, ay double, rx0 double, ry0 double, rx1 double, ry1 double")
    things = spark.createDataFrame([("d", 0, 100.0, 100.0, 200.0, 200.0, "rect"), ("d", 0, 0.0, 300.0, 600.0, 300.0, "seg")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, kind string")
    pages = spark.createDataFrame([("d", 0, 600.0, 600.0)], "doc_id string, page int, width double, height double")
    got = [(r["bx"], r["by"]) for r in spatial.placed(anchors, things, pages).collect()]
    assert len(got) == 25
    assert all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= (9 * 2.4) ** 2 for i, a in enumerate(got) for b in got[:i])
    first = spark.createDataFrame([("e", 0, 0, 300.0, 300.0, none, none, none, none)], anchors.schema)
    at = spatial.placed(first, things, pages.withColumn("doc_id", F.lit("e"))).first()
    assert (at["bx"], at["by"]) == pytest.approx((300.0, 300.0 - 9 * 1.9))


def test_sessions_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ledger": [{"uid": 1, "page": 0, "type": "attr", "group": "finish / x", "nominal": 5, "measured": "GO"}, {"uid": 1, "type": "dim"}], "next_num": 4}')
    (tmp_path / "broken.json").write_text("{nonsense")
    got = session.read_sessions(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["doc_id"], r["seq"], r["bubble"], r["type"]) for r in got] == [("a", 1, "1a", "finish / wykończenie"), ("a", 2, "1b", "dim")]
    session.write_sessions(session.read_sessions(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert session.merged_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"x": 5}, "b": 2}) == {"a": {"x": 5, "y": 2}, "b": 2}
    session.write_config(spark, str(tmp_path / "conf"), {"b": 7})
    assert session.read_config(spark, str(tmp_path / "conf"), {"a": 1, "b": 2}) == {"a": 1, "b": 7}
    assert session.read_config(spark, str(tmp_path / "none"), {"a": 1}) == {"a": 1}


def test_sheet_and_labels(spark, sf, tmp_path):
    from dimlark.plans import fixtures

    led = ledger.renumber(fixtures.ledger(spark, sf))
    sheet.ensure_sheet(led, str(tmp_path / "s"))
    assert sheet.read_sheet(spark, str(tmp_path / "s")).isEmpty()
    sheet.write_sheet(led, str(tmp_path / "s"))
    sheet.ensure_sheet(led, str(tmp_path / "s"))
    assert sheet.read_sheet(spark, str(tmp_path / "s")).count() == led.count() and sheet.overfull(led).isEmpty()
    full = spark.range(305).select(F.lit("d").alias("doc_id"), F.col("id").alias("seq"), F.lit(None).cast("int").alias("sheet_row"))
    slots = sheet.allocated(full)
    assert slots.where("sheet_row IS NULL").count() == 5 and sheet.overfull(full).count() == 1
    quads = spark.createDataFrame([("train", "train_000001", 3, [(-5.0, 320.0), (700.0, 0.0)])], "split string, stem string, cls int, quad array<struct<x:double,y:double>>")
    line = quads.withColumn("line", labels.label_line(F.col("cls"), F.col("quad")))
    assert line.first()["line"] == "3 0.000000 0.500000 1.000000 0.000000"
    labels.write_labels(line, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).count() == 1
    (tmp_path / "img").mkdir()
    for name in ("shot_110635.png", "hole_note 2.png", "other.png"):
        (tmp_path / "img" / name).write_bytes(b"x")
    paths = labels.listed(spark, str(tmp_path / "img"))
    truth = spark.createDataFrame([("110635", ["note"])], "code string, classes array<string>")
    assert sorted(r["cls"] for r in labels.single_class_crops(paths, truth, paths).collect()) == ["hole_note", "note"]


def test_settings_and_review(spark, tmp_path):
    from dimlark.operators import rows

    defaults = {"a": 1, "s": {"x": 1, "y": 2}}
    given = ['{"s": {"x": 5}, "b": "t"}', '{"s": 3, "a": null}', "{broken", None, "", '{"a": {"q": 1}}']
    got = values(spark, session.merged_settings(F.col("x"), defaults), given)
    plain = {"a": "1", "s.x": "1", "s.y": "2"}
    assert got == [{"a": "1", "b": "t", "s.x": "5", "s.y": "2"}, {"a": None, "s": "3"}, plain, plain, plain, {"a": '{"q":1}', "s.x": "1", "s.y": "2"}]
    table = spark.createDataFrame(list(enumerate(got)), "id long, settings map<string,string>")
    session.write_settings(table, str(tmp_path / "settings"))
    assert sorted((r["id"], sorted(r["settings"].items())) for r in session.read_settings(spark, str(tmp_path / "settings")).collect()) == [(i, sorted(g.items())) for i, g in enumerate(got)]
    items = spark.createDataFrame([(1, "BARE", None, "dim", "LWH"), (2, "BARE", 0.1, "dim", "LWH"), (3, "REF", None, "dim", "LWH"), (4, None, None, "dim", "LWH"), (5, "BASIC", None, "dim", "LWH")], "ord int, sb string, tol_sym double, type string, group string")
    over = spark.createDataFrame([(3, True, "GD&T"), (4, None, "hole / otwór")], "ord int, include boolean, type string")
    assert sorted((r["ord"], r["type"], r["group"]) for r in rows.reviewed(items, over, ("ord",)).collect()) == [(2, "dim", "LWH"), (3, "GD&T", "GD&T"), (4, "hole / otwór", "holes Ø / otwory")]


def test_measurement_stream(spark, tmp_path):
    feed = spark.createDataFrame([("2024-01-01 10:05:00", 1, "10.05"), ("2024-01-01 10:20:00", 1, "11"), ("2024-01-01 11:10:00", 2, "NOK")], "ts string, uid long, measured string").withColumn("ts", F.col("ts").cast("timestamp"))
    feed.write.parquet(str(tmp_path / "feed"))
    limits = spark.createDataFrame([(1, 10.0, 0.1, None, None), (2, 5.0, 0.1, None, None)], "uid long, nominal double, tol_sym double, tol_max double, tol_min double")
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    query = measurements.windowed(measurements.judged(stream, limits)).writeStream.outputMode("complete").format("memory").queryName("judged_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {str(r["start"])[11:13]: (r["n"], r["n_out"]) for r in spark.table("judged_counts").collect()}
    assert got == {"10": (2, 1), "11": (1, 1)}


def test_readers(spark):
    out = values(spark, detect.located_text(F.col("x"), F.lit(1000), F.lit(1000)), ["Ø10<loc_0><loc_1><loc_2><loc_3><loc_4><loc_5><loc_6><loc_7>", "no places", " <loc_1><loc_2><loc_3><loc_4><loc_5><loc_6><loc_7><loc_8>"])
    assert [[r["text"] for r in o] for o in out] == [["Ø10"], [], []] and out[0][0]["points"][0]["x"] == pytest.approx(0.5)
    results = ['{"rec_texts": ["a", " "], "rec_boxes": [[0,0,1,1],[0,0,1,1]], "rec_scores": [0.5]}', '{"parsing_res_list": [{"content": "b", "bbox": [1,2,3,4]}]}', "{}"]
    assert [[r["text"] for r in o] for o in values(spark, detect.reader_rows(F.col("x")), results)] == [["a"], ["b"], []]
    assert detect.chosen_reader(["x", "y"], ["y"]) == "y" and detect.chosen_reader(["x"], []) is None


def test_no_driver_gathering_in_the_library():
    import pathlib

    for path in pathlib.Path(lines.__file__).parents[1].rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\.(collect|toPandas|localCheckpoint)\(\)", path.read_text()), path
