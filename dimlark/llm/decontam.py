"""Benchmark decontamination by a generalised suffix automaton over the items' words.

The automaton holds all word sequences that occur in any normalised item. A document's words
stream through it; at each word it tells the longest sequence ending there that occurs in an
item. Where that is ``window`` words or more, all of those words are hit; items of fewer words
count as one window each. Words outside the items' vocabulary reset the automaton to its
start, so only stretches of known words are streamed.

Items are packed into blocks of at most ``block_words`` words, longer items in overlapping
pieces, as a written table. Each block has its own automaton, and one automaton at a time is in
a Python worker, which builds it once and keeps it for its next task: documents pass block after
block, and the hits of a text, found by its digest, are united. The number of passes follows the
benchmark; with one block nothing is shuffled.

Cases: null and empty texts have no words; an item without words has no window. Items with
the same id count once. Items with a null id hit, but have no id to list. Repeated documents are judged alike. An empty benchmark hits nothing.
Columns among ``id_cols`` that are named like outputs are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, table, written

#: ASCII letters and digits and all bytes from 128 up make words; the letters are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class SuffixAutomaton:
    """All factors of the items' word sequences. ``feed`` gives the hits of a document's words."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            at = 0
            for w in word_ids:
                at = self._extend(at, w)
        self.shortest = min([window, *(len(w) for _, w in coded)])
        #: items of which the state's window-long sequence is a part
        self.holders: dict[int, set] = {}
        #: (length, item) of items shorter than a window that end in the state
        self.wholes: dict[int, list[tuple[int, object]]] = {}
        for item, word_ids in coded:
            at = 0
            for n, w in enumerate(word_ids, 1):
                at = self.moves[at][w]
                if n >= window:
                    self.holders.setdefault(self._window_state(at), set()).add(item)
            if len(word_ids) < window:
                self.wholes.setdefault(at, []).append((len(word_ids), item))
        #: the nearest state on the way to the start, the state itself first, at which a short item ends
        self.whole_above = [-1] * len(self.link)
        for at in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.whole_above[at] = at if at in self.wholes else self.whole_above[self.link[at]]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, before: int, w: int, after: int) -> int:
        """The state of the sequences into ``after`` that are not longer than ``before`` and ``w``."""
        if self.length[after] == self.length[before] + 1:
            return after
        part = self._state(self.length[before] + 1, self.link[after], dict(self.moves[after]))
        self.link[after] = part
        while before >= 0 and self.moves[before].get(w) == after:
            self.moves[before][w] = part
            before = self.link[before]
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.moves[last]:
            return self._split(last, w, self.moves[last][w])
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and w not in self.moves[at]:
            self.moves[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, w, self.moves[at][w])
        return new

    def _window_state(self, at: int) -> int:
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def feed(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark the hit words and add the items whose windows occur."""
        known = self.vocabulary.get
        word_ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, word_ids >= 0, False].astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long_enough = ends - starts >= self.shortest
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            state = matched = 0
            for i, w in enumerate(word_ids[start:end].tolist(), start + 1):
                while state and w not in self.moves[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if (after := self.moves[state].get(w)) is not None:
                    state, matched = after, matched + 1
                if matched >= self.window:
                    hit[i - matched : i] = True
                    items |= self.holders[self._window_state(state)]
                above = self.whole_above[state]
                while above > 0:
                    for n, item in self.wholes[above]:
                        if n <= matched:
                            hit[i - n : i] = True
                            items.add(item)
                    above = self.whole_above[self.link[above]]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, window: int) -> DataFrame:
    """``(item, words, block)``: the items' words, in blocks of at most ``block_words`` (of two windows at least).

    A longer item is cut into pieces that overlap by a window less a word, so each window is whole in one.
    """
    most = max(block_words, 2 * window)
    rows = benchmark.select(col(item_col).cast("string").alias("item"), col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_buffer().to_pybytes())
                pieces = [words[i : i + most] for i in range(0, max(1, len(words) - window + 1), most - window + 1)] if words else []
                found += [(item, b" ".join(piece), len(piece)) for piece in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["item", "words", "n"])

    pieces = written(rows.mapInArrow(cut, "item string, words binary, n long").distinct(), "benchmark-words")
    parts = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // most))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, room = TaskContext.get().partitionId() << 32, most
        for batch in batches:
            numbers = []
            for n in batch.column(2).to_pylist():
                if n > room:
                    block, room = block + 1, most
                room -= n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64())], names=["item", "words", "block"])

    return written(pieces.repartition(int(parts)).mapInArrow(packed, "item string, words binary, block long"), "benchmark-blocks")


def shared_block(blocks: DataFrame, number: int | None):
    """One block of bounded size, broadcast."""
    rows = blocks.where(F.col("block") == number).collect() if number is not None else []
    return blocks.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])


#: The automaton that this Python worker built last, by its block's name.
BUILT: dict[str, SuffixAutomaton] = {}


def automaton_of(name: str, shared, window: int) -> SuffixAutomaton:
    """The block's automaton, built once in a worker; that of another block goes first."""
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = SuffixAutomaton([(item, words.split()) for item, words in shared.value], window)
    return BUILT[name]


def block_hits(texts: DataFrame, shared, window: int) -> DataFrame:
    """``texts(digest, text)`` -> ``(digest, edges, items)`` of those that the block hits; edges: starts and ends of runs of hit words."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(name, shared, window)
        for batch in batches:
            digests, edges, found = [], [], []
            for digest, value in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(value.as_buffer().to_pybytes())
                hit, items = np.zeros(len(words), bool), set()
                automaton.feed(words, hit, items)
                if items:
                    digests.append(digest.as_py())
                    edges.append(run_edges(hit))
                    found.append(sorted(items - {None}))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(edges, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["digest", "edges", "items"])

    return texts.mapInArrow(run, "digest string, edges array<int>, items array<string>")


def run_edges(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist()


OUTPUTS = (
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
)


def scan(docs: DataFrame, benchmark: DataFrame, *, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 250_000, null_items: bool = True) -> DataFrame:
    """The columns ``id_cols`` of each row, and what is hit in its text.

    ``n_words``, ``n_hit``; ``items``: ids, as sorted strings, of items with occurring windows;
    ``spans``: [start, end) in code points of each longest run of hit words.
    """
    items = benchmark if null_items else benchmark.where(col(item_col).isNotNull())
    blocks = item_blocks(items, item_col, item_text_col, block_words, window)
    numbers = sorted(r["block"] for r in blocks.select("block").distinct().collect())
    id_cols = tuple(c for c in id_cols if c.lower() not in {n for n, _ in OUTPUTS})
    rows = docs.select(*[col(c) for c in id_cols if c != text_col], col(text_col).cast("binary").alias("__text"), *[col(text_col)] * (text_col in id_cols))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    shared = None
    if len(numbers) > 1:
        texts, passes = rows.select(F.md5("__text").alias("digest"), "__text").where("__text IS NOT NULL"), []
        for number in numbers:
            block = shared_block(blocks, number)
            passes.append(written(block_hits(texts, block, window).dropDuplicates(["digest"]), "block-hits"))
            block.destroy()
        united = reduce(DataFrame.union, passes).groupBy("digest").agg(F.flatten(F.collect_list("edges")).alias("__edges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
        united = written(united, "hits").withColumnRenamed("digest", "__digest")
        rows = rows.join(united, F.md5("__text") == F.col("__digest"), "left").drop("__digest")
    else:
        shared = shared_block(blocks, numbers[0] if numbers else None)
    place, name = {c: i for i, c in enumerate(rows.columns)}, uuid.uuid4().hex
    kept_places = [place[f.name] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(name, shared, window) if shared else None
        for batch in batches:
            n_words, n_hit, found, spans = [], [], [], []
            for i, value in enumerate(batch.column(place["__text"])):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                words = words_of(text)
                hit, items = np.zeros(len(words), bool), set()
                if automaton:
                    automaton.feed(words, hit, items)
                else:
                    edges = batch.column(place["__edges"])[i].as_py() or []
                    for start, end in zip(edges[::2], edges[1::2], strict=True):
                        hit[start:end] = True
                    items.update(batch.column(place["__items"])[i].as_py() or ())
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                found.append(sorted(items - {None}))
                spans.append(hit_spans(text, hit) if n_hit[-1] else [])
            kept = [batch.column(i) for i in kept_places]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                names=[*[f.name for f in fields], *[n for n, _ in OUTPUTS]],
            )

    return rows.mapInArrow(run, T.StructType([*fields, *[T.StructField(n, t) for n, t in OUTPUTS]]))


def hit_spans(text: bytes, hit: np.ndarray) -> list[list[int]]:
    """[start, end) in code points of each longest run of hit words."""
    places = [m.span() for m in WORD_TEXT.finditer(text.decode("utf-8", "replace"))]
    edges = run_edges(hit)
    return [[places[a][0], places[b - 1][1]] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def without_spans(text, spans):
    """Column: the text without its [start, end) spans, which are in order and apart."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s[0] - acc["at"])).alias("out"), s[1].alias("at")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", window: int = 10, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without hit runs of words; a document of which more than ``max_coverage`` is hit goes whole.

    Rows without a hit stay as they are. ``chars_col``, if it is a column, becomes the new length.
    """
    names = docs.columns
    marked = scan(docs.withColumns({f"__in_{i}": col(c) for i, c in enumerate(names)}).select(*[f"__in_{i}" for i in range(len(names))]), benchmark, id_cols=tuple(f"__in_{i}" for i in range(len(names))), text_col=f"__in_{names.index(text_col)}", window=window, **options)
    kept = marked.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    text = F.col(f"__in_{names.index(text_col)}")
    changed = F.when(F.col("n_hit") > 0, without_spans(text, F.col("spans"))).otherwise(text)
    out = {n: F.col(f"__in_{i}") for i, n in enumerate(names)} | {text_col: changed}
    if chars_col in names:
        n_chars = F.col(f"__in_{names.index(chars_col)}")
        out[chars_col] = F.when(F.col("n_hit") > 0, F.length(changed).cast(docs.schema[chars_col].dataType)).otherwise(n_chars)
    return kept.select(*[out[n].alias(n) for n in names])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
n AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM n, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
dw AS (SELECT r, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) s, LATERAL (SELECT unnest(range(1, len(w) - s.n + 2)) AS i)),
m AS (SELECT r, i, n, item FROM dw JOIN win USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
x AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""
