"""Number reading and printing with Python's rules, as columns.

Garbage gives NULL where Python would raise; ``nan`` and ``inf`` count as garbage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def py_float(text: Column) -> Column:
    """``float(text)``: blanks at the ends are left off."""
    s = F.trim(text)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def fnum(text: Column) -> Column:
    """A number with a decimal comma or point; empty is NULL."""
    return py_float(F.replace(text, F.lit(","), F.lit(".")))


def is_garbage(text: Column) -> Column:
    """Whether ``fnum`` was given text that is no number."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & fnum(text).isNull()


def py_g(x: Column) -> Column:
    """``'%g' % x``: six significant digits, no trailing zeros.

    A number whose shortest decimal form lies half way between two is rounded up, where Python
    looks at the binary value (99999.95 is 100000 here).
    """
    sci = F.format_string("%.5e", x)
    mantissa, power = F.split_part(sci, F.lit("e"), F.lit(1)), F.split_part(sci, F.lit("e"), F.lit(2))
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = bare(sci.try_cast("decimal(30,12)").cast("string"))
    exponent = power.try_cast("int")
    text = F.when((exponent >= -4) & (exponent < 6), plain).otherwise(F.concat(bare(mantissa), F.lit("e"), power))
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0").otherwise(text)


def py_g_signed(x: Column) -> Column:
    """``'%+g' % x``."""
    return F.when(x < 0, py_g(x)).otherwise(F.concat(F.lit("+"), py_g(x)))


def decimals(text: Column) -> Column:
    """Digits after the point of a number's text, decimal comma allowed; empty is NULL."""
    s = F.trim(F.replace(text, F.lit(","), F.lit(".")))
    return F.when(s != "", F.when(F.contains(s, F.lit(".")), F.length(F.regexp_extract(s, r"(?s)^[^.]*\.(.*)$", 1))).otherwise(0))


def dp_of_text(text: Column) -> Column:
    """Decimal places as written."""
    return decimals(text)


def dp_of_number(x: Column) -> Column:
    """Decimal places as ``%g`` prints the number."""
    return decimals(py_g(x))


def dp_tol(dp: Column, enabled: bool, tols: dict[str, float]) -> Column:
    """± by decimal places, the place clamped at 3; only positive entries count."""
    if not enabled:
        return F.lit(None).cast("double")
    out = F.lit(None).cast("double")
    for place in range(4):
        if tols.get(str(place), 0) > 0:
            out = F.when((dp >= 3) if place == 3 else (dp == place), F.lit(float(tols[str(place)]))).otherwise(out)
    return out


def base_of(bubble: Column) -> Column:
    """Number of a label without its letters; empty is 0, other garbage NULL."""
    digits = F.regexp_replace(bubble, "[a-z]+$", "")
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))


def bubble_sortkey(bubble: Column) -> Column:
    """Number, then its letters as digits to base 26, in thousandths."""
    suffix = F.regexp_extract(bubble, "([a-z]*)$", 1)
    letters = F.filter(F.split(suffix, ""), lambda c: c != "")
    value = F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a * 26 + F.instr(F.lit(LETTERS), c))
    return base_of(bubble).cast("double") + value / 1000
