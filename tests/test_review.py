"""The review as a log: marks, edits in their order, rows built anew, and the cases about them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dimlark.operators.review import reviewed_by_log

HITS = "doc_id string, page int, ord int, tp string, sb string, v string, t string, raw string, thru boolean"
LOG = "doc_id string, at long, ord long, use boolean, type string, gage string, t string"
SCANNED = [
    ("d", 0, 0, "LINEAR", None, "10", "±0.1", "10 ±0.1", None),
    ("d", 0, 1, "LINEAR", "REF", "20", "REF", "(20)", None),
    ("d", 0, 2, "FIT", None, "Ø10", "g6", "Ø10 g6", None),
    ("d", 0, 3, "LINEAR", "BARE", "7.5", None, "7.5", None),
    ("e", 0, 0, "LINEAR", None, "10", None, "10", None),
]


@pytest.fixture
def rows(spark):
    hits = spark.createDataFrame(SCANNED, HITS)
    gtols = spark.createDataFrame([("d", 0, {"0": 0.5})], "doc_id string, page int, tols map<string,double>")

    def of(*log):
        out = reviewed_by_log(hits, spark.createDataFrame(list(log), LOG), gtols)
        return {(r["doc_id"], r["ord"]): r for r in out.collect()}

    return of


def test_without_a_log_rows_are_as_scanned(rows):
    got = rows()
    assert len(got) == 5 and [got["d", i]["use"] for i in range(4)] == [True, False, True, False]
    assert got["d", 0]["tol_sym"] == 0.1 and got["d", 2]["type"] == "dim" and got["e", 0]["tol_sym"] is None


def test_a_new_tolerance_builds_the_row_anew(rows):
    got = rows(("d", 1, None, None, None, None, " H7 "), ("d", 1, 9, True, None, None, None), ("nowhere", 1, None, None, "dim", "x", "±1"))
    fit = got["d", 2]
    assert (fit["t"], fit["type"], fit["feature"], fit["tol_max"], fit["tol_min"]) == ("H7", "hole / otwór", "Ø10 (fit H7)", 0.015, 0.0)
    assert fit["gage"] == "CMM"
    # what is no tolerance of a plain length leaves it to the page's
    assert (got["d", 0]["tol_sym"], got["d", 1]["t"]) == (0.5, "REF")


def test_edits_reach_what_is_checked_at_their_time(rows):
    got = rows(
        ("d", 1, None, None, "slot / rowek", "", None),
        ("d", 2, None, True, None, None, None),
        ("d", 3, 0, False, None, None, None),
        ("d", 4, None, None, None, "micrometer", "±0.02"),
        ("d", 5, None, None, " ", "  ", ""),
        ("d", 6, 3, False, None, None, None),
        ("d", 7, None, None, "my own", None, None),
    )
    assert [got["d", i]["use"] for i in range(4)] == [False, True, True, False]
    assert [got["d", i]["type"] for i in range(4)] == ["slot / rowek", "my own", "my own", "dim"]
    # an own type has no group of its own: the scanned one stays
    assert [got["d", i]["group"] for i in range(4)] == ["positions / pozycje", "LWH", "LWH", "LWH"]
    assert [got["d", i]["gage"] for i in range(4)] == ["CMM", "micrometer", "micrometer", "micrometer"]
    assert [got["d", i]["tol_sym"] for i in range(4)] == [0.1, 0.02, 0.02, 0.02]
    assert got["e", 0]["use"] and got["e", 0]["type"] == "dim"


def test_empty_tables(spark, rows):
    gtols = spark.createDataFrame([], "doc_id string, page int, tols map<string,double>")
    none = reviewed_by_log(spark.createDataFrame([], HITS), spark.createDataFrame([("d", 1, None, True, None, None, None)], LOG), gtols)
    assert none.isEmpty() and none.select("use", "gage").dtypes == [("use", "boolean"), ("gage", "string")]
    assert none.where(F.col("tol_sym") > 0).isEmpty()
