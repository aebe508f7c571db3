"""Places and running totals within groups of any size.

A window over a group puts all its rows in one task. Here rows are dealt by ranges of the group
and the order instead, so a group of a third of all rows is spread over a third of the tasks.
Each task's stretch of a group is summed, the sums of the stretches before it (a row for each
stretch) are added up, and a window runs within a stretch alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: How a running total is formed: over rows, and of what stands before a stretch with what stands in it.
TOTALS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def placed(df: DataFrame, key: str, order: tuple[str, ...], running: dict[str, tuple[str, str]] | None = None, *, tag: str) -> DataFrame:
    """``df`` with ``place`` (from 0) of each row within its ``key``, by ``order``, nulls first, and ``of``, the group's rows.

    ``running`` names totals: ``{name: (column, "sum" or "bit_xor")}``, each up to and with its
    row; the columns are longs without nulls. ``key`` holds no nulls. Rows alike in ``order`` are told apart by where they
    were read, which the written table fixes. Columns ``nth`` and ``stretch`` are used inside.
    """
    running = running or {}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("nth", F.monotonically_increasing_id())
    rows = written(rows.repartitionByRange(tasks, key, *order, "nth").withColumn("stretch", F.spark_partition_id()), tag)
    totals = {"place": (F.lit(1).cast("long"), "sum")} | {name: (F.col(c), how) for name, (c, how) in running.items()}
    sums = rows.groupBy(key, "stretch").agg(*[TOTALS[how][0](c).alias(f"in_{name}") for name, (c, how) in totals.items()])
    whole = Window.partitionBy(key)
    ahead = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(TOTALS[how][0](F.col(f"in_{name}")).over(ahead), F.lit(0).cast("long")).alias(f"before_{name}") for name, (_, how) in totals.items()]
    sums = sums.select(key, "stretch", F.sum("in_place").over(whole).alias("of"), *before)
    within = Window.partitionBy(key, "stretch").orderBy(*order, "nth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, [key, "stretch"])
    upto = {name: TOTALS[how][1](F.col(f"before_{name}"), TOTALS[how][0](c).over(within)) for name, (c, how) in totals.items()}
    upto["place"] = upto["place"] - 1
    return out.select(*[F.col(c) for c in df.columns], "of", *[c.alias(name) for name, c in upto.items()])
