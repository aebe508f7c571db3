"""Acceptance limits and the two verdicts: the application's and the sheet's. They disagree on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pyfmt import fnum, py_float, py_g, py_g_signed

#: Fixed values.
APP_FAIL_WORDS = ("NOGO", "NO-GO", "NO GO", "NOK", "FAIL", "NIE")
SHEET_PASS_WORDS = ("GO", "OK", "PASS", "TAK")
SHEET_FAIL_WORDS = ("NOGO", "NO GO", "FAIL", "NIE")
SLACK = 1e-9


def tol_text(sym: Column, tmax: Column, tmin: Column) -> Column:
    """A row's tolerance as shown: ±s, upper/lower, or one side and a question mark."""
    both = F.concat(py_g_signed(F.greatest(tmax, tmin)), F.lit("/"), py_g_signed(F.least(tmax, tmin)))
    one = F.concat(py_g_signed(F.coalesce(tmax, tmin)), F.lit("/?"))
    return F.when(sym.isNotNull(), F.concat(F.lit("±"), py_g(sym))).when(tmax.isNull() & tmin.isNull(), "").when(tmax.isNotNull() & tmin.isNotNull(), both).otherwise(one)


def limits(nominal: Column, sym: Column, tmax: Column, tmin: Column) -> Column:
    """Struct ``lo, hi``, or NULL when unknown: ± goes first, else both sides must be given."""
    pair = lambda lo, hi: F.struct((nominal + lo).alias("lo"), (nominal + hi).alias("hi"))
    return F.when(nominal.isNotNull() & sym.isNotNull(), pair(F.lit(0.0) - F.abs(sym), F.abs(sym))).when(
        nominal.isNotNull() & tmax.isNotNull() & tmin.isNotNull(), pair(F.least(tmax, tmin), F.greatest(tmax, tmin))
    )


def out_of_tol(nominal: Column, sym: Column, tmax: Column, tmin: Column, measured: Column) -> Column:
    """The application's verdict: True when the measured value or word is out."""
    text = F.trim(F.coalesce(measured, F.lit("")))
    value, lim = fnum(measured), limits(nominal, sym, tmax, tmin)
    outside = ~((value >= lim["lo"] - SLACK) & (value <= lim["hi"] + SLACK))
    return F.when(text == "", F.lit(False)).when(value.isNull(), F.upper(text).isin(*APP_FAIL_WORDS)).otherwise(F.coalesce(outside, F.lit(False)))


def bench_target(nominal: Column, offset: Column, pin: Column) -> Column:
    """Sheet column K: what the gage should read."""
    return nominal + F.coalesce(offset, F.lit(0.0)) - F.coalesce(pin, F.lit(0.0)) / 2


def sheet_number(measured: Column) -> Column:
    """A measured cell as a number, if the export writes one."""
    return py_float(F.replace(measured, F.lit(","), F.lit(".")))


def sheet_verdict(nominal: Column, sym: Column, tmax: Column, tmin: Column, offset: Column, pin: Column, measured: Column) -> Column:
    """Sheet column M: PASS, FAIL or empty."""
    value, k = sheet_number(measured), bench_target(nominal, offset, pin)
    both = tmax.isNotNull() & tmin.isNotNull()
    known = nominal.isNotNull() & (both | sym.isNotNull())
    low = k + F.when(both, F.least(tmax, tmin)).when(tmin.isNotNull(), tmin).otherwise(F.lit(0.0) - F.abs(sym))
    high = k + F.when(both, F.greatest(tmax, tmin)).when(tmax.isNotNull(), tmax).otherwise(F.abs(sym))
    word = F.upper(F.coalesce(measured, F.lit("")))
    by_word = F.when(word.isin(*SHEET_PASS_WORDS), "PASS").when(word.isin(*SHEET_FAIL_WORDS), "FAIL").otherwise("")
    return F.when(value.isNull(), by_word).when(~known, "").when((value >= low) & (value <= high), "PASS").otherwise("FAIL")
