"""The inspection sheet as tables: row slots, typed cells, verdict summary, header and draw list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pyfmt import base_of, fnum, py_g
from ..functions.verdict import tol_text
from ..operators.ledger import first_on_page
from ..schema import FIRST_ROW, GROUPS, LAST_ROW
from .atomic import has_table, read_table, write_table

# Sheet columns, and the template's drop-down lists and header cells.
COLUMNS = {"A": "bubble", "B": "type", "C": "group", "D": "feature", "E": "nominal", "F": "tol_sym", "G": "tol_max", "H": "tol_min", "I": "pin", "J": "offset", "L": "measured", "N": "tier", "O": "gage"}
NUMERIC = ("E", "F", "G", "H", "I", "J", "L")
TYPE_LIST = ("dim", "hole / otwór", "thread / gwint", "thru / przelot", "slot / rowek", "attr")
TIER_LIST = ("red", "blue", "green")
HEADER = ("B3", "E3", "H3", "B4", "E4", "H4", "B5", "E5", "H5", "B6", "E6", "H6", "J6")
EXITS = {"n": (0, -1), "s": (0, 1), "e": (1, 0), "w": (-1, 0)}


def cell_texts() -> dict[str, Column]:
    """FIL-3: what the panel shows for the number columns."""
    return {
        "nominal": F.coalesce(F.format_string("%.2f", F.col("nominal")), F.lit("")),
        "pin": F.coalesce(py_g(F.col("pin")), F.lit("")),
        "tol": tol_text(F.col("tol_sym"), F.col("tol_max"), F.col("tol_min")),
        "measured": F.coalesce("measured", F.lit("")),
    }


def free_slot(held: Column, rank: Column) -> Column:
    """The sheet row of that rank, from 1, among those that ``held`` has not; NULL when the sheet is full.

    Before the i-th row held lie ``row - FIRST_ROW - i`` free ones; where that is under the rank, the row found is one later.
    """
    before = F.filter(F.sort_array(held), lambda row, i: row - F.lit(FIRST_ROW) - i < rank)
    at = F.lit(FIRST_ROW - 1) + rank + F.size(before)
    return F.when((rank <= LAST_ROW - FIRST_ROW + 1) & (at <= LAST_ROW), at)


def allocated(ledger: DataFrame) -> DataFrame:
    """IO-11: rows without a sheet row get the first free ones in order; NULL when the sheet is full. ``is_new`` marks them.

    A drawing's rows held are one array, no longer than the sheet, so slots are reckoned and not listed.
    """
    own = Window.partitionBy("doc_id")
    new, row = F.col("sheet_row").isNull(), F.col("sheet_row")
    held = F.collect_set(F.when(row.between(FIRST_ROW, LAST_ROW), row)).over(own)
    rank = F.count(F.when(new, True)).over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    rows = ledger.withColumns({"is_new": new, "__held": held, "__rank": rank})
    slot = F.when(F.col("doc_id").isNotNull(), free_slot(F.col("__held"), F.col("__rank")))
    return rows.withColumn("sheet_row", F.coalesce(row, slot)).drop("__held", "__rank")


def overfull(ledger: DataFrame) -> DataFrame:
    """Drawings whose rows outnumber the sheet's."""
    return ledger.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > LAST_ROW - FIRST_ROW + 1)


def cells(ledger: DataFrame) -> DataFrame:
    """IO-12: two columns for each sheet column: a number if it reads as one there, else a text; empty is NULL."""
    out = []
    for letter, name in COLUMNS.items():
        text = F.nullif(F.col(name).cast("string"), F.lit(""))
        if letter in NUMERIC:
            number = fnum(text) if name == "measured" else F.col(name).cast("double")
            out += [number.alias(f"{letter.lower()}_num"), F.when(number.isNull(), text).alias(f"{letter.lower()}_text")]
        else:
            out.append(text.alias(f"{letter.lower()}_text"))
    return ledger.select("doc_id", "seq", "sheet_row", *out)


def cleared(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """IO-13: written rows without ``gone(doc_id, sheet_row)``."""
    return rows.join(gone, ["doc_id", "sheet_row"], "left_anti")


def write_sheet(ledger: DataFrame, path: str) -> None:
    """IO-12, IO-14: the cells in place of an earlier sheet; a job that fails leaves that one whole."""
    write_table(cells(ledger), path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sheet's cells as last written."""
    return read_table(spark, path)


def ensure_sheet(ledger: DataFrame, path: str) -> None:
    """IO-9: an empty sheet, unless one is there already."""
    if not has_table(path):
        write_table(cells(ledger.limit(0)), path)


def header_rows(header: DataFrame) -> DataFrame:
    """IO-10: ``doc_id`` and a column for each header cell -> ``doc_id, cell, value``."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in HEADER)
    return header.selectExpr("doc_id", f"stack({len(HEADER)}, {pairs}) AS (cell, value)").withColumn("value", F.coalesce("value", F.lit("")))


def header_table(rows: DataFrame) -> DataFrame:
    """IO-10: the other way."""
    return rows.groupBy("doc_id").pivot("cell", list(HEADER)).agg(F.first("value"))


def summary(judged: DataFrame, *keys: str) -> DataFrame:
    """SHT-3: rows, measured, PASS, FAIL and yield; ``result`` is the sheet's verdict."""
    good, bad = F.count_if(F.col("result") == "PASS"), F.count_if(F.col("result") == "FAIL")
    return judged.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("measured").alias("n_measured"), good.alias("n_pass"), bad.alias("n_fail"), F.try_divide(good.cast("double"), good + bad).alias("yield"))


def sheet_style(result: Column) -> Column:
    """SHT-4."""
    return F.when(result == "PASS", "green").when(result == "FAIL", "red").otherwise("")


def panel_style(out_of_tol: Column) -> Column:
    return F.when(out_of_tol, "red").otherwise("")


def outside_lists(ledger: DataFrame) -> DataFrame:
    """SHT-5: ``column_name, value, n`` of values that the drop-down lists do not offer."""
    lists = {"type": TYPE_LIST, "group": GROUPS, "tier": TIER_LIST}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in lists])).alias("p")
    known = F.coalesce(*[F.when(F.col("column_name") == c, F.col("value").isin(*v)) for c, v in lists.items()])
    return ledger.select(pairs).select("p.*").groupBy("column_name", "value").agg(F.count("*").alias("n")).where(~known)


def draw_list(ledger: DataFrame, radius: float = 9.0) -> DataFrame:
    """IO-15, GEO-10: a balloon for each page and number: circle at ``bx, by``, leader from ``sx, sy`` to ``x, y``."""
    rows = first_on_page(ledger)
    away = ~((F.col("bx") == F.col("x")) & (F.col("by") == F.col("y")))
    start = leader_start(F.col("bx"), F.col("by"), F.col("x"), F.col("y"), F.col("lexit"), radius)
    return rows.select(
        "doc_id",
        F.coalesce("page", F.lit(0)).alias("page"),
        base_of(F.col("bubble")).alias("base"),
        "bx",
        "by",
        F.lit(radius).alias("radius"),
        start["x"].alias("sx"),
        start["y"].alias("sy"),
        "x",
        "y",
        (away & F.coalesce("leader", away)).alias("has_leader"),
    )


def leader_start(bx: Column, by: Column, x: Column, y: Column, lexit: Column, radius: float) -> Column:
    """Where the leader leaves the circle: the exit side, or towards the anchor."""
    dx, dy = x - bx, y - by
    d = F.sqrt(dx * dx + dy * dy)
    unit = lambda v: F.when(d > 0, v / d).otherwise(F.lit(0.0)) * radius
    sx, sy = bx + unit(dx), by + unit(dy)
    for side, (ex, ey) in EXITS.items():
        sx, sy = F.when(lexit == side, bx + ex * radius).otherwise(sx), F.when(lexit == side, by + ey * radius).otherwise(sy)
    return F.struct(sx.alias("x"), sy.alias("y"))
