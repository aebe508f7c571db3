"""Undo and redo as a log of changes, in place of copies of whole ledgers.

An edit of a drawing is a version: for each row that it inserts, deletes or changes, the log has
the row before and after. What is in effect follows from the drawing's commands: an edit puts its
version on top and forgets what was undone, undo takes the top off, redo puts it back; only the
last ``depth`` edits can be undone. Versions in effect ascend, so a ledger is its base with, for each
row, what the highest of them says: one grouping, whatever the number of versions. The
way back is the log's inverse: what a row was before the lowest version that goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A drawing's ledger row is known by these; ``rid`` stays with it, whatever its place.
KEYS = ["doc_id", "rid"]
DEPTH = 50


def fields_of(ledger: DataFrame) -> list[str]:
    return [c for c in ledger.columns if c not in KEYS]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """HIST-1: ``doc_id, rid, kind, before, after`` of rows that two states of ledgers do not share.

    ``kind`` is 'inserted', 'deleted' or 'changed'; ``before`` and ``after`` are structs of the
    row's other columns, NULL where there is no row.
    """
    row = F.struct(*[F.col(c) for c in fields_of(before)])
    old = before.select(*KEYS, row.alias("before"))
    new = after.select(*before.columns).select(*KEYS, row.alias("after"))
    kind = F.when(F.col("before").isNull(), "inserted").when(F.col("after").isNull(), "deleted").otherwise("changed")
    return old.join(new, KEYS, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(*KEYS, kind.alias("kind"), "before", "after")


def logged(log: DataFrame | None, before: DataFrame, after: DataFrame, version: int | Column) -> DataFrame:
    """``log`` with the changes between two states as ``version`` of their drawings."""
    new = changes(before, after).withColumn("version", F.lit(version).cast("long"))
    return new if log is None else log.unionByName(new)


def pointers(commands: DataFrame, depth: int = DEPTH) -> DataFrame:
    """HIST-2: ``commands(doc_id, version, op)`` -> ``doc_id, applied, undone, undoable``.

    ``op``: 'edit', which makes its ``version``, 'undo' or 'redo'. ``applied``: versions in effect,
    ascending; ``undone``: those that redo brings back, the next one last. Undo and redo do
    nothing where there is nothing to take, as does any other word.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("applied"), none.alias("undone"), F.lit(0).alias("undoable"))
    rows = commands.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("version").cast("long").alias("version"), "op"))).alias("c"))

    def step(a: Column, c: Column) -> Column:
        top = lambda s: F.try_element_at(a[s], F.lit(-1))
        rest = lambda s: F.slice(a[s], F.lit(1), F.size(a[s]) - 1)
        state = lambda applied, undone, n: F.struct(applied.alias("applied"), undone.alias("undone"), n.cast("int").alias("undoable"))
        edit = state(F.array_append(a["applied"], c["version"]), none, F.least(a["undoable"] + 1, F.lit(depth)))
        undo = state(rest("applied"), F.array_append(a["undone"], top("applied")), a["undoable"] - 1)
        redo = state(F.array_append(a["applied"], top("undone")), rest("undone"), a["undoable"] + 1)
        return F.when(c["op"] == "edit", edit).when((c["op"] == "undo") & (a["undoable"] > 0), undo).when((c["op"] == "redo") & (F.size(a["undone"]) > 0), redo).otherwise(a)

    return rows.select("doc_id", F.aggregate("c", start, step).alias("s")).select("doc_id", "s.*")


def overlaid(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """``ledger`` with each row of ``rows(doc_id, rid, row)`` in place of its own, or without it where ``row`` is NULL."""
    fields = fields_of(ledger)
    new = rows.select(*KEYS, F.col("row").alias("__row"), F.lit(True).alias("__told"))
    joined = ledger.withColumn("__own", F.lit(True)).join(new, KEYS, "full").where((F.col("__told").isNull()) | F.col("__row").isNotNull())
    return joined.select(*[c if c in KEYS else F.when(F.col("__told"), F.col("__row")[c]).otherwise(F.col(c)).alias(c) if c in fields else c for c in ledger.columns])


def replayed(base: DataFrame, log: DataFrame, state: DataFrame) -> DataFrame:
    """HIST-2: the ledgers with the versions that ``state(doc_id, applied)`` has in effect, from ``base`` on."""
    versions = state.select("doc_id", F.explode("applied").alias("version"))
    last = log.join(versions, ["doc_id", "version"]).groupBy(*KEYS).agg(F.max_by(F.struct("after"), "version")["after"].alias("row"))
    return overlaid(base, last)


def moved(ledger: DataFrame, log: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """HIST-3: ``ledger``, which is as of state ``old``, as of state ``new``, by the log's inverses and what comes again.

    Only rows that differ are touched. States are ``(doc_id, applied)``; one is the other with
    versions taken off or put on at its end, as undo and redo make them, or both.
    """
    both = old.select("doc_id", F.col("applied").alias("__old")).join(new.select("doc_id", "applied"), "doc_id")
    gone = both.select("doc_id", F.explode(F.array_except("__old", "applied")).alias("version"), F.lit(True).alias("gone"))
    come = both.select("doc_id", F.explode(F.array_except("applied", "__old")).alias("version"), F.lit(False).alias("gone"))
    told = log.join(gone.unionByName(come), ["doc_id", "version"])
    back = F.min_by(F.when(F.col("gone"), F.struct("before")), F.when(F.col("gone"), F.col("version")))["before"]
    again = F.max_by(F.when(~F.col("gone"), F.struct("after")), F.when(~F.col("gone"), F.col("version")))
    last = told.groupBy(*KEYS).agg(again.alias("__again"), back.alias("__back"))
    return overlaid(ledger, last.select(*KEYS, F.when(F.col("__again").isNotNull(), F.col("__again.after")).otherwise(F.col("__back")).alias("row")))


def compacted(base: DataFrame, log: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``base``, ``log`` and ``state`` with the versions that can't be undone any more worked into the base.

    Versions that neither are in effect nor can be redone leave the log.
    """
    cut = F.greatest(F.size("applied") - F.col("undoable"), F.lit(0))
    fixed = state.select("doc_id", F.slice("applied", F.lit(1), cut).alias("applied"))
    kept = state.select("doc_id", F.slice("applied", cut + 1, F.size("applied")).alias("applied"), "undone", "undoable")
    live = kept.select("doc_id", F.explode(F.concat("applied", "undone")).alias("version"))
    return replayed(base, log, fixed), log.join(live, ["doc_id", "version"], "left_semi"), kept


def sheet_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """HIST-3: ``doc_id, sheet_row, clear`` after going from one state to another: rows to clear, and those to write again."""
    held = lambda df: df.where("sheet_row IS NOT NULL").select("doc_id", "sheet_row").distinct()
    gone = held(old).join(held(new), ["doc_id", "sheet_row"], "left_anti")
    return gone.withColumn("clear", F.lit(True)).unionByName(held(new).withColumn("clear", F.lit(False)))
