"""An extension, not parity: measurements judged as they arrive, and late-safe counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.verdict import out_of_tol


def judged(feed: DataFrame, limits: DataFrame) -> DataFrame:
    """``feed(ts, uid, measured)`` joined with a static ``limits(uid, nominal, tol_sym, tol_max, tol_min)``; no state is kept."""
    rows = feed.join(limits, "uid", "left")
    return rows.withColumn("oot", out_of_tol(F.col("nominal"), F.col("tol_sym"), F.col("tol_max"), F.col("tol_min"), F.col("measured")))


def windowed(judged_feed: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts for each window; what comes later than ``late`` is left out, which bounds the state."""
    return judged_feed.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.count_if("oot").alias("n_out")).select(F.col("window.start").alias("start"), "n", "n_out")
