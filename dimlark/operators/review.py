"""A review of scanned callouts as a log: check marks, bulk edits of what is checked then, and rows built anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP_OF, EngineConf
from .rows import rows_of_hits, suggest_gage, used, with_general_tols

EDITS = ("type", "gage", "t")


def logged(log: DataFrame) -> DataFrame:
    """``doc_id, entries``: a drawing's log in its order, blank cells as NULL. A drawing's log is of a session's length."""
    cells = [F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in EDITS]
    entry = F.struct("at", F.col("ord").cast("long").alias("ord"), "use", *cells)
    return log.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def reviewed_by_log(hits: DataFrame, log: DataFrame, gtols: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    """ROW-11: ``hits(doc_id, page, ord, hit columns)`` under ``log(doc_id, at, ord, use, type, gage, t)``, as ledger rows with ``use`` and ``gage``.

    An entry with ``use`` checks or unchecks row ``ord`` of the drawing, or all its rows without
    ``ord``. An entry without ``use`` edits every row that is checked at that time: its type, gage
    and tolerance text where given; a blank keeps what is there. A new tolerance text replaces the
    hit's, so that the row is built from it once more: limits of a fit, the hole that a fit code
    means, general tolerances of the page. A new type brings its group, if it has one. A gage that
    was given stays, else it is suggested from the finished row. Rows start checked as ``used``
    says. Entries of equal ``at`` go by their cells. Rows of drawings without a log are as scanned;
    entries without a row do nothing. One join, and one fold for each row.
    """
    made = with_general_tols(rows_of_hits(hits), gtols, conf)
    rows = made.join(logged(log), "doc_id", "left")
    none = F.lit(None).cast("string")
    start = F.struct(used(F.col("sb"), F.col("tol_sym")).alias("use"), *[none.alias(c) for c in EDITS])
    own = F.filter(F.coalesce("entries", F.array()), lambda e: e["ord"].isNull() | (e["ord"] == F.col("ord")))

    def step(state, entry):
        edits = entry["use"].isNull() & state["use"]
        return F.struct(F.coalesce(entry["use"], state["use"]).alias("use"), *[F.when(edits & entry[c].isNotNull(), entry[c]).otherwise(state[c]).alias(c) for c in EDITS])

    rows = rows.withColumn("__state", F.aggregate(own, start, step)).drop("entries")
    rows = rows.withColumns({"t": F.coalesce("__state.t", "t"), "use": F.col("__state.use")})
    rows = with_general_tols(rows_of_hits(rows), gtols, conf)
    given = F.col("__state.type")
    group = F.coalesce(*[F.when(given == t, F.lit(g)) for t, g in GROUP_OF.items()], F.col("group"))
    rows = rows.withColumns({"type": F.coalesce(given, "type"), "group": group})
    gage = suggest_gage(F.col("type"), F.col("group"), F.col("tol_sym"), F.col("tol_max"), F.col("tol_min"), conf)
    return rows.withColumn("gage", F.coalesce("__state.gage", gage)).drop("__state")
