"""ISO 286 fits and ISO 2768 general tolerances, as CASE columns and as broadcast range joins.

Each table below is small and fixed, so its dimension rows have a proven size bound.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of ISO 286-1, in micrometres; a column for each nominal band.
BANDS = (3, 6, 10, 18, 30, 50, 80, 120, 180, 250, 315, 400, 500)
IT = {
    4: (3, 4, 4, 5, 6, 7, 8, 10, 12, 14, 16, 18, 20),
    5: (4, 5, 6, 8, 9, 11, 13, 15, 18, 20, 23, 25, 27),
    6: (6, 8, 9, 11, 13, 16, 19, 22, 25, 29, 32, 36, 40),
    7: (10, 12, 15, 18, 21, 25, 30, 35, 40, 46, 52, 57, 63),
    8: (14, 18, 22, 27, 33, 39, 46, 54, 63, 72, 81, 89, 97),
    9: (25, 30, 36, 43, 52, 62, 74, 87, 100, 115, 130, 140, 155),
    10: (40, 48, 58, 70, 84, 100, 120, 140, 160, 185, 210, 230, 250),
    11: (60, 75, 90, 110, 130, 160, 190, 220, 250, 290, 320, 360, 400),
    12: (100, 120, 150, 180, 210, 250, 300, 350, 400, 460, 520, 570, 630),
}
UPPER = {
    "d": (-20, -30, -40, -50, -65, -80, -100, -120, -145, -170, -190, -210, -230),
    "e": (-14, -20, -25, -32, -40, -50, -60, -72, -85, -100, -110, -125, -135),
    "f": (-6, -10, -13, -16, -20, -25, -30, -36, -43, -50, -56, -62, -68),
    "g": (-2, -4, -5, -6, -7, -9, -10, -12, -14, -15, -17, -18, -20),
    "h": (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
}
LOWER = {
    "k": (0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4, 5),
    "m": (2, 4, 6, 7, 8, 9, 11, 13, 15, 17, 20, 21, 23),
    "n": (4, 8, 10, 12, 15, 17, 20, 23, 27, 31, 34, 37, 40),
    "p": (6, 12, 15, 18, 22, 26, 32, 37, 43, 50, 56, 62, 68),
}
FINE_BANDS = (3, 6, 10, 18, 30, 50, 65, 80, 100, 120, 140, 160, 180, 200, 225, 250, 280, 315, 355, 400, 450, 500)
FINE_LOWER = {
    "r": (10, 15, 19, 23, 28, 34, 41, 43, 51, 54, 63, 65, 68, 77, 80, 84, 94, 98, 108, 114, 126, 132),
    "s": (14, 19, 23, 28, 35, 43, 53, 59, 71, 79, 92, 100, 108, 122, 130, 140, 158, 170, 190, 208, 232, 252),
}
FIT_CODE = r"^(JS|js|[A-HK-NPRSa-hk-nprs])([0-9]{1,2})$"

# Fixed values of ISO 2768: upper end of a band and its tolerance for each class.
LINEAR_ENDS = (3, 6, 30, 120, 400, 1000, 2000, 4000)
LINEAR = {
    "f": (0.05, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, None),
    "m": (0.1, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0),
    "c": (0.2, 0.3, 0.5, 0.8, 1.2, 2.0, 3.0, 4.0),
    "v": (None, 0.5, 1.0, 1.5, 2.5, 4.0, 6.0, 8.0),
}
RADIUS_ENDS = (3, 6, 1e9)
RADIUS = {"f": (0.2, 0.5, 1.0), "m": (0.2, 0.5, 1.0), "c": (0.4, 1.0, 2.0), "v": (0.4, 1.0, 2.0)}
ANGLE_ENDS = (10, 50, 120, 400, 1e9)
ANGLE = {
    "f": (1.0, 0.5, 1 / 3, 1 / 6, 1 / 12),
    "m": (1.0, 0.5, 1 / 3, 1 / 6, 1 / 12),
    "c": (1.5, 1.0, 0.5, 1 / 3, 1 / 6),
    "v": (3.0, 2.0, 1.0, 0.5, 1 / 3),
}
FLATNESS_ENDS = (10, 30, 100, 300, 1000, 3000)
FLATNESS = {"H": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4), "K": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8), "L": (0.1, 0.2, 0.4, 0.8, 1.2, 1.6)}
SQUARE_ENDS = (10, 30, 100, 300)
PERPENDICULARITY = {"H": (0.2, 0.3, 0.4, 0.5), "K": (0.4, 0.6, 0.8, 1.0), "L": (0.6, 1.0, 1.5, 2.0)}
SYMMETRY = {"H": (0.5, 0.5, 0.5, 0.5), "K": (0.6, 0.6, 0.8, 1.0), "L": (0.6, 1.0, 1.5, 2.0)}
RUNOUT = {"H": 0.1, "K": 0.2, "L": 0.5}

#: kind -> (ends of bands, tolerances, where the first band begins)
GENERAL = {
    "linear": (LINEAR_ENDS, LINEAR, 0.5),
    "radius": (RADIUS_ENDS, RADIUS, 0.5),
    "angle": (ANGLE_ENDS, ANGLE, 0.0),
    "flatness": (FLATNESS_ENDS, FLATNESS, 0.0),
    "perpendicularity": (SQUARE_ENDS, PERPENDICULARITY, 0.0),
    "symmetry": (SQUARE_ENDS, SYMMETRY, 0.0),
}


def is_fit_code(code: Column) -> Column:
    return F.coalesce(F.trim(code).rlike(FIT_CODE), F.lit(False))


@lru_cache(maxsize=1)
def fit_rows() -> list[tuple[str, int, float, float, int, int]]:
    """Every supported class and band: (letter, grade, over, up to, upper, lower) in micrometres.

    Holes mirror shafts: H and looser by sign alone, K to S with the step between two grades
    added up to IT8 (K, M, N) or IT7 (P, R, S).
    """
    out = []
    for grade, widths in IT.items():
        for over, upto in pairwise((0, *FINE_BANDS)):
            coarse = next(i for i, b in enumerate(BANDS) if upto <= b)
            width = widths[coarse]
            finer = IT.get(grade - 1)
            step = 0 if upto <= 3 else width - finer[coarse] if finer else None
            low = {letter: x[coarse] for letter, x in LOWER.items()} | {letter: x[FINE_BANDS.index(upto)] for letter, x in FINE_LOWER.items()}
            if not 4 <= grade <= 7:
                low["k"] = 0
            found: dict[str, tuple[float, float]] = {"js": (width / 2, -width / 2), "JS": (width / 2, -width / 2)}
            for letter, values in UPPER.items():
                found[letter] = (values[coarse], values[coarse] - width)
                found[letter.upper()] = (width - values[coarse], -values[coarse])
            for letter, value in low.items():
                found[letter] = (value + width, value)
                top: float | None
                if letter in "kmn":
                    top = (None if step is None else step - value) if grade <= 8 else 0 if letter == "n" else None
                    if letter == "m" and grade == 6 and 250 < upto <= 315:
                        top = -9
                else:
                    top = -value if grade > 7 else None if step is None else step - value
                if top is not None:
                    found[letter.upper()] = (top, top - width)
            out += [(letter, grade, float(over), float(upto), round(hi / 1000, 4), round(lo / 1000, 4)) for letter, (hi, lo) in found.items()]
    return out


def fit_letter(code: Column) -> Column:
    return F.regexp_extract(F.trim(code), FIT_CODE, 1)


def fit_grade(code: Column) -> Column:
    return F.regexp_extract(F.trim(code), FIT_CODE, 2).try_cast("int")


def fit_table(spark: SparkSession) -> DataFrame:
    """The rows as a table: ``letter, grade, over, upto, upper, lower``."""
    values = ", ".join(f"('{a}', {g}, {lo}D, {hi}D, {u}D, {v}D)" for a, g, lo, hi, u, v in fit_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(letter, grade, over, upto, upper, lower)")


def with_fit_limits(df: DataFrame, nominal: Column, code: Column) -> DataFrame:
    """``df`` with ``upper`` and ``lower`` in mm, by a broadcast join on letter, grade and band; NULL outside the tables."""
    dims = F.broadcast(fit_table(df.sparkSession))
    letter, grade = F.coalesce(fit_letter(code), F.lit("")), F.coalesce(fit_grade(code), F.lit(-1))
    inner = df.withColumns({"__letter": letter, "__grade": grade, "__nominal": nominal})
    on = (F.col("__letter") == dims["letter"]) & (F.col("__grade") == dims["grade"]) & (F.col("__nominal") > dims["over"]) & (F.col("__nominal") <= dims["upto"])
    return inner.join(dims, on, "left").drop("__letter", "__grade", "__nominal", "letter", "grade", "over", "upto")


def fit_limits(nominal: Column, code: Column, wanted: tuple[str, ...] | None = None) -> Column:
    """Struct ``upper, lower`` by CASE: no join. ``wanted``: the codes that can occur, for a short plan."""
    chain = None
    for letter, grade, over, upto, hi, lo in fit_rows():
        if wanted is not None and f"{letter}{grade}" not in wanted:
            continue
        cond = (F.trim(code) == f"{letter}{grade}") & (nominal > over) & (nominal <= upto)
        value = F.struct(F.lit(hi).cast("double").alias("upper"), F.lit(lo).cast("double").alias("lower"))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain if chain is not None else F.lit(None).cast("struct<upper:double,lower:double>")


def by_case(cases: list[tuple[Column, object]], kind: str) -> Column:
    """One flat CASE; NULL where no case holds."""
    (first, value), *rest = cases
    out = F.when(first, F.lit(value).cast(kind))
    for cond, v in rest:
        out = out.when(cond, F.lit(v).cast(kind))
    return out


def banded(nominal: Column, ends: tuple[int, ...], values) -> list[tuple[Column, object]]:
    """Cases of the bands (over, up to]."""
    return [((nominal > over) & (nominal <= upto), v) for (over, upto), v in zip(pairwise((0, *ends)), values, strict=True)]


def it_value(nominal: Column, grade: Column) -> Column:
    """Standard tolerance in micrometres."""
    return by_case([((grade == g) & c, w) for g, widths in IT.items() for c, w in banded(nominal, BANDS, widths)], "int")


def band_index(nominal: Column) -> Column:
    return by_case(banded(nominal, BANDS, range(len(BANDS))), "int")


def shaft_upper(letter: str, nominal: Column) -> Column:
    """Fundamental deviation es of d to h, in micrometres."""
    return by_case(banded(nominal, BANDS, UPPER[letter]), "int")


def shaft_lower(letter: str, nominal: Column, grade: Column) -> Column:
    """Fundamental deviation ei of k to s, in micrometres; k is 0 outside grades 4 to 7."""
    out = by_case(banded(nominal, FINE_BANDS, FINE_LOWER[letter]) if letter in FINE_LOWER else banded(nominal, BANDS, LOWER[letter]), "int")
    return F.when(out.isNotNull() & ~grade.between(4, 7), 0).otherwise(out) if letter == "k" else out


def grade_step(nominal: Column, grade: Column) -> Column:
    """IT(n) - IT(n-1); 0 up to 3 mm."""
    return F.when(nominal <= 3, 0).otherwise(it_value(nominal, grade) - it_value(nominal, grade - 1))


def general_tol(kind: str, size: Column, cls: Column) -> Column:
    """ISO 2768 tolerance; an end of a band belongs to the band below it."""
    ends, table, first = GENERAL[kind]
    return by_case([((cls == name) & (size >= over) & (size <= upto), v) for name, values in table.items() for (over, upto), v in zip(pairwise((first, *ends)), values, strict=True)], "double")


def general_table(spark: SparkSession, kind: str) -> DataFrame:
    """The same as rows: ``cls, over, upto, tol``; the first band holds its lower end too."""
    ends, table, first = GENERAL[kind]
    rows = [(c, -1.0 if i == 0 else float(o), float(first) if i == 0 else float(o), float(u), v) for c, values in table.items() for i, ((o, u), v) in enumerate(zip(pairwise((first, *ends)), values, strict=True))]
    values = ", ".join(f"('{c}', {o}D, {f}D, {u}D, {'CAST(NULL AS DOUBLE)' if v is None else f'{v!r}D'})" for c, o, f, u, v in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(cls, over, least, upto, tol)")


def with_general_tol(df: DataFrame, kind: str, size: Column, cls: Column) -> DataFrame:
    """``df`` with ``tol``, by a broadcast range join."""
    dims = F.broadcast(general_table(df.sparkSession, kind)).withColumnRenamed("cls", "__cls")
    inner = df.withColumns({"__size": size, "__class": cls})
    on = (F.col("__class") == dims["__cls"]) & (F.col("__size") > dims["over"]) & (F.col("__size") >= dims["least"]) & (F.col("__size") <= dims["upto"])
    return inner.join(dims, on, "left").drop("__size", "__class", "__cls", "over", "least", "upto")


def runout_tol(cls: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, v in RUNOUT.items():
        out = F.when(cls == name, v).otherwise(out)
    return out
