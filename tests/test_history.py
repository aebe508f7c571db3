"""The log of changes against stacks of whole copies."""

from __future__ import annotations

import random

import pytest

from dimlark.operators import history

LEDGER = "doc_id string, rid long, measured string, sheet_row int"
DEPTH = 3


class Copies:
    """A drawing's ledger with undo and redo by copies."""

    def __init__(self, rows):
        self.rows, self.undone, self.past = dict(rows), [], []

    def edit(self, rows):
        self.past = [*self.past, self.rows][-DEPTH:]
        self.rows, self.undone = dict(rows), []

    def undo(self):
        if self.past:
            self.undone.append(self.rows)
            self.rows = self.past.pop()

    def redo(self):
        if self.undone:
            self.past.append(self.rows)
            self.rows = self.undone.pop()


def edited(dice, rows):
    out = dict(rows)
    for rid in list(out):
        if dice.random() < 0.15:
            del out[rid]
        elif dice.random() < 0.3:
            out[rid] = (dice.choice([None, "1", "2", "GO"]), out[rid][1])
    for _ in range(dice.randrange(3)):
        out[dice.randrange(50)] = (dice.choice([None, "new"]), dice.choice([None, 11]))
    return out


def frame(spark, states):
    return spark.createDataFrame([(d, rid, *row) for d, rows in states.items() for rid, row in rows.items()], LEDGER)


def rows_of(df):
    out = {}
    for r in df.select("doc_id", "rid", "measured", "sheet_row").collect():
        assert (r["doc_id"], r["rid"]) not in out
        out[r["doc_id"], r["rid"]] = (r["measured"], r["sheet_row"])
    return out


def wanted(states):
    return {(d, rid): row for d, rows in states.items() for rid, row in rows.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_log_against_copies(spark, seed):
    dice = random.Random(seed)
    base = {f"d{i}": {rid: (dice.choice([None, "x"]), dice.choice([None, rid + 11])) for rid in range(dice.randrange(6))} for i in range(8)}
    docs = {d: Copies(rows) for d, rows in base.items()}
    commands, log, before, states, marks = [], [], {}, None, {}
    for version in range(1, 19):
        for d, doc in docs.items():
            op = dice.choice(["edit", "edit", "undo", "redo", "undo", "other"])
            commands.append((d, version, op))
            if op == "edit":
                new = edited(dice, doc.rows)
                for rid in sorted({*doc.rows, *new}):
                    if doc.rows.get(rid) != new.get(rid):
                        log.append((d, rid, version, doc.rows.get(rid), new.get(rid)))
                doc.edit(new)
            elif op in ("undo", "redo"):
                getattr(doc, op)()
        marks[version] = {d: dict(doc.rows) for d, doc in docs.items()}
    row = "struct<measured:string,sheet_row:int>"
    table = spark.createDataFrame(log, f"doc_id string, rid long, version long, before {row}, after {row}")
    told = spark.createDataFrame(commands, "doc_id string, version long, op string")
    start = frame(spark, base)
    final = history.pointers(told, DEPTH).cache()
    assert rows_of(history.replayed(start, table, final)) == wanted(marks[18])
    middle = history.pointers(told.where("version <= 9"), DEPTH).cache()
    assert rows_of(history.replayed(start, table, middle)) == wanted(marks[9])
    assert rows_of(history.moved(frame(spark, marks[9]), table, middle, final)) == wanted(marks[18])
    assert rows_of(history.moved(frame(spark, marks[18]), table, final, middle)) == wanted(marks[9])
    small, short, state = history.compacted(start, table, final)
    assert rows_of(history.replayed(small, short, state)) == wanted(marks[18])
    assert short.select("doc_id", "version").distinct().groupBy("doc_id").count().where(f"count > {DEPTH + 18}").isEmpty()
    assert state.where("size(applied) <> undoable").isEmpty()


def test_changes_and_depth(spark):
    old = frame(spark, {"a": {1: ("x", 11), 2: (None, None), 3: ("y", None)}, "b": {1: ("x", 1)}})
    new = frame(spark, {"a": {1: ("x", 11), 2: ("z", None), 4: (None, 12)}, "b": {1: ("x", 1)}})
    got = {(r["doc_id"], r["rid"]): (r["kind"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in history.changes(old, new).collect()}
    assert got == {("a", 2): ("changed", (None, None), ("z", None)), ("a", 3): ("deleted", ("y", None), None), ("a", 4): ("inserted", None, (None, 12))}
    assert history.logged(history.logged(None, old, new, 1), new, old, 2).count() == 6
    many = spark.createDataFrame([("d", n, "edit") for n in range(1, 61)] + [("d", n, "undo") for n in range(61, 121)] + [("d", 121, "redo")], "doc_id string, version long, op string")
    state = history.pointers(many).first()
    assert state["applied"] == list(range(1, 12)) and len(state["undone"]) == 49 and state["undoable"] == 1
    gone = {(r["sheet_row"], r["clear"]) for r in history.sheet_rows(old.where("doc_id = 'a'"), new.where("doc_id = 'a'")).collect()}
    assert gone == {(11, False), (12, False)}
    assert history.pointers(many.limit(0)).isEmpty() and history.changes(old.limit(0), new.limit(0)).isEmpty()
