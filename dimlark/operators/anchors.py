"""Where on its page a callout stands: its rectangle's centre, else its text found there, else a slot in the margin.

A page's words are joined in reading order, and one automaton of all spellings that the page's
callouts ask for goes over them once, however many there are. A map from characters to words
gives the place back.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_needles
from .ledger import margin_slots

KEYS = ["doc_id", "page"]


def folded(text: str) -> str:
    """Lower case, letter by letter, so that places stay; runs of white space as one space."""
    low = "".join(c if len(low := c.lower()) != 1 else low for c in text)
    return " ".join(low.split())


class PageText:
    """A page's words in reading order as one folded text."""

    def __init__(self, words: pd.DataFrame):
        ordered = words.sort_values(["block", "line", "word", "x0"], kind="stable")
        self.texts = [folded(t or "") for t in ordered["text"]]
        self.boxes = ordered[["x0", "y0", "x1", "y1"]].to_numpy(float)
        self.lines = list(zip(ordered["block"], ordered["line"], strict=True))
        self.starts, at = [], 0
        for t in self.texts:
            self.starts.append(at)
            at += len(t) + 1
        self.body = " ".join(self.texts)

    def first_places(self, needles: Iterable[str]) -> dict[str, int]:
        """The first place of each needle that occurs, all found in one pass."""
        automaton = ahocorasick.Automaton()
        for needle in needles:
            automaton.add_word(needle, needle)
        found: dict[str, int] = {}
        if len(automaton):
            automaton.make_automaton()
            for end, needle in automaton.iter(self.body):
                found.setdefault(needle, end + 1 - len(needle))
        return found

    def rect(self, start: int, length: int) -> list[float]:
        """Around the words that a match touches, as far as they stand on its first line."""
        first = bisect_right(self.starts, start) - 1
        last = bisect_right(self.starts, start + length - 1) - 1
        own = [i for i in range(first, last + 1) if self.lines[i] == self.lines[first] and self.texts[i]]
        boxes = self.boxes[own]
        return [*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)]


FOUND = "doc_id string, page int, ord long, needle string, x0 double, y0 double, x1 double, y1 double"


def searched(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """``wanted(doc_id, page, ord, needles array<string>)`` -> FOUND: each one's first needle that is on its page, at its first place.

    Case and the kind of white space do not matter; a match may run over line ends and begin or
    end within words. What is not found has no row, and empty needles find nothing.
    """

    def run(asked: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(page):
            text = PageText(page)
            lists = [[(n, f) for n in needles if n and (f := folded(n))] for needles in asked["needles"]]
            places = text.first_places({f for needles in lists for _, f in needles})
            for doc_id, page_no, ord_, needles in zip(asked["doc_id"], asked["page"], asked["ord"], lists, strict=True):
                hit = next(((n, f) for n, f in needles if f in places), None)
                if hit:
                    out.append((doc_id, page_no, ord_, hit[0], *text.rect(places[hit[1]], len(hit[1]))))
        return pd.DataFrame(out, columns=["doc_id", "page", "ord", "needle", "x0", "y0", "x1", "y1"])

    own = words.select(*KEYS, "block", "line", "word", "text", "x0", "y0", "x1", "y1")
    asked = wanted.select(F.col("doc_id"), F.col("page"), F.col("ord").cast("long").alias("ord"), "needles")
    own = own.join(asked.select(*KEYS).distinct(), KEYS, "left_semi").withColumnsRenamed({"doc_id": "__doc", "page": "__page"})
    # names of their own: both sides may come from one table
    own = own.select(*[F.col(c).alias(c) for c in own.columns])
    return asked.groupBy(*KEYS).cogroup(own.groupBy("__doc", "__page")).applyInPandas(run, FOUND)


def anchored(items: DataFrame, words: DataFrame, height: float) -> DataFrame:
    """ROW-12: ``items(doc_id, page, ord, raw, v, rect)`` with ``ax, ay, anchored, how`` ('rect', 'search' or 'margin').

    Without a rectangle the spellings of ``raw`` and then of ``v`` are searched for (SCAN-7); what
    is on no page goes down its margin, in order.
    """
    needles = F.concat(*[F.coalesce(search_needles(F.col(c)), F.array().cast("array<string>")) for c in ("raw", "v")])
    lost = items.where(F.col("rect").isNull()).select(*KEYS, "ord", needles.alias("needles"))
    found = searched(lost, words).select(*KEYS, "ord", ((F.col("x0") + F.col("x1")) / 2).alias("__sx"), ((F.col("y0") + F.col("y1")) / 2).alias("__sy"))
    rows = items.join(found, [*KEYS, "ord"], "left")
    how = F.when(F.col("rect").isNotNull(), "rect").when(F.col("__sx").isNotNull(), "search").otherwise("margin")
    centre = lambda a, b: (F.col(f"rect.{a}") + F.col(f"rect.{b}")) / 2
    rows = rows.withColumn("how", how).withColumns({"ax": F.coalesce(centre("x0", "x1"), "__sx"), "ay": F.coalesce(centre("y0", "y1"), "__sy")}).drop("__sx", "__sy")
    placed = rows.where("how <> 'margin'")
    slots = margin_slots(rows.where("how = 'margin'"), height).withColumns({"ax": F.col("mx"), "ay": F.col("my")}).drop("mx", "my")
    return placed.unionByName(slots).withColumn("anchored", F.col("how") != "margin")
