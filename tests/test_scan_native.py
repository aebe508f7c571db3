"""Lines joined by columns against a plain loop, and rules chosen by their triggers against all rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from dimlark.functions import text
from dimlark.operators import scan
from dimlark.plans import fixtures

DEV = re.compile(r"(?:[+\-]\s*[\d.,]+|0(?:[.,]\d+)?)$")


def plain_joined(value):
    """One window after the other, changed lines seen by the next."""
    lines = value.split("\n")
    for width in (3, "lower", "count"):
        n = 3 if width == 3 else 2
        for i in range(len(lines) - n + 1):
            w = [line.strip() for line in lines[i : i + n]]
            new = None
            if width == 3 and w[0][-1:].isdecimal() and DEV.match(w[1]) and DEV.match(w[2]) and (w[1][:1] in tuple("+-") or w[2][:1] in tuple("+-")):
                new = f"{w[0]} {w[1].replace(' ', '')}/{w[2].replace(' ', '')}"
            elif width == "lower" and re.search(r"\d\s*[+\-][\d.,]*\d$", w[0]) and "/" not in w[0].split()[-1] and DEV.match(w[1]):
                new = f"{w[0]}/{w[1].replace(' ', '')}"
            elif width == "count" and re.match(r"\d+[Xx×]$", w[0]) and re.match(r"[.\d]", w[1]):
                new = f"{w[0]} {w[1]}"
            elif width == "count" and re.match(r"[.\d]+$", w[0]) and re.match(r"\d+[Xx×]$", w[1]):
                new = f"{w[1]} {w[0]}"
            if new is not None:
                lines[i : i + n] = [new, *[""] * (n - 1)]
    return "\n".join(line for line in lines if line)


def test_lines_joined_against_a_plain_loop(spark):
    dice = random.Random(6)
    pieces = ["25", "+0.1", "- 0.2", "0", "12 +0.3", "4X", "3x", "7.5", "", "  ", " 25 ", "note", "Ø9 -0.1", "1/2", "0,05", "+1", "٣"]
    texts = ["\n".join(dice.choice(pieces) for _ in range(dice.randrange(1, 9))) for _ in range(600)] + ["", "\n", "a", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r["id"]: r["new"] for r in df.select("id", text.lines_joined(F.col("text")).alias("new")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else plain_joined(t)), t


def test_triggers_choose_no_rule_too_few(spark, sf):
    assert len(scan.TRIGGERS) == len(scan.RULES) == 28
    dice = random.Random(2)
    said = [p[0].replace("#", "12") for p in fixtures.PIECES] + ["t.p. 0.1", "true pos 0.2", "c'bore 5", "c'ſink 7", "CSK 3", "ø8", "rz 3,2", "45 deg", "fim 0.1", "circularity .5", "ﬂatness 0.1", "ﬁt 3h7"]
    texts = [dice.choice([" ", "\n", ", "]).join(dice.choice([str.upper, str.lower, str.title, str])(dice.choice(said)) for _ in range(dice.randrange(1, 5))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("up", F.upper("text"))
    chosen, every = scan.claimed(F.col("text"), upper=F.col("up")), scan.claimed(F.col("text"))
    assert df.select("id", chosen.alias("a"), every.alias("b")).where("NOT (a <=> b)").isEmpty()


def test_scans_run_without_python(spark, sf):
    from dimlark.plans.drawing_queries import QUERIES

    plan = QUERIES["SCAN-2"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
