"""Substring dedup by line hashing, with lines cut into pieces where their words say so.

A text is cut at line ends, and within a line behind each word that, with the next one, meets a
fixed condition on their letters (one pair in ``CUT_PARTS``). A passage that starts or ends in the
middle of a line so holds whole pieces that are the same wherever it stands, which whole lines,
sentences or paragraphs are not. A piece is normalised (lower case, its words joined by one
space) and hashed to 96 bits. Equal digests are grouped over all documents: the earliest piece by
document id, then by place, stays. The others go where ``min_words`` words or more of them stand
side by side; shorter runs are chance and stay.

A digest that is very common costs one row for each task before the shuffle that groups it, and
the join that brings the earliest id back to its pieces is split by Spark where it is skewed.

Cases: null and empty texts have no pieces. Null ids rank last, as one document. Rows that share
an id rank alike: a piece that is first in one of them stays in each, and only repeats within a
row's text go; each text under such an id has runs of its own, and rows alike in both count once. Letters that ``str.lower`` lengthens are lower-cased word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, table, written

TOKEN = re.compile(r"[^\W_]+|\n")
#: One pair of words in so many ends a piece.
CUT_PARTS = 7
#: Pieces that a task holds at once.
HELD = 100_000
#: Letter sums that a task remembers.
REMEMBERED = 1_000_000


class Cutter:
    """Cuts texts into pieces; sums of words' code points are remembered within a task, up to a bound."""

    def __init__(self):
        self.sums: dict[str, int] = {}

    def letters(self, word: str) -> int:
        if (known := self.sums.get(word)) is None:
            known = sum(map(ord, word))
            if len(self.sums) < REMEMBERED:
                self.sums[word] = known
        return known

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """(start, end, words, normalised text) of each piece; places in code points."""
        places, low = [m.span() for m in TOKEN.finditer(text)], text.lower()
        words = [low[a:b] for a, b in places] if len(low) == len(text) else [text[a:b].lower() for a, b in places]
        begin, before = 0, -1
        for i, word in enumerate(words):
            if word == "\n":
                if begin < i:
                    yield places[begin][0], places[i - 1][1], i - begin, " ".join(words[begin:i])
                begin, before = i + 1, -1
                continue
            own = self.letters(word)
            if before >= 0 and (5 * before + 3 * own) % CUT_PARTS == 0:
                yield places[begin][0], places[i - 1][1], i - begin, " ".join(words[begin:i])
                begin = i
            before = own
        if begin < len(words):
            yield places[begin][0], places[-1][1], len(words) - begin, " ".join(words[begin:])


UNITS = (("h1", "long"), ("h2", "int"), ("at", "int"), ("start", "int"), ("end", "int"), ("words", "int"), ("again", "boolean"))


def units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", versions: bool = False) -> DataFrame:
    """A row for each piece: ``id``, with ``versions`` also the text's hash ``version``, and UNITS.

    ``h1, h2``: the digest; ``at``: the piece's number; ``again``: whether the same text held it before.
    """
    extra = [F.xxhash64(col(text_col)).alias("version")] if versions else []
    rows = docs.select(col(id_col).alias("id"), *extra, col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter()
        for batch in batches:
            owner, digests, found = [], [], []

            def told() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), dtype=[("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")])  # noqa: B023
                at, start, end, words, again = (np.array(c) for c in zip(*found, strict=True))  # noqa: B023
                kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(owner, pa.int32()))  # noqa: B023
                own = [pa.array(np.ascontiguousarray(h["h1"])), pa.array(np.ascontiguousarray(h["h2"])), *[pa.array(c.astype(np.int32)) for c in (at, start, end, words)], pa.array(again)]
                return pa.RecordBatch.from_arrays([*kept.columns, *own], names=[*kept.schema.names, *[n for n, _ in UNITS]])

            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                seen: set[bytes] = set()
                for at, (start, end, words, norm) in enumerate(cut(text.as_py() or "")):
                    digest = xxhash.xxh3_128_digest(norm.encode("utf-8", "replace"))
                    owner.append(i)
                    digests.append(digest)
                    found.append((at, start, end, words, digest in seen))
                    seen.add(digest)
                    if len(owner) >= HELD:
                        yield told()
                        owner, digests, found = [], [], []
            if owner:
                yield told()

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, kind + "".join(f", {n} {t}" for n, t in UNITS))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, versions: bool = False) -> DataFrame:
    """A row for each run of pieces to remove.

    ``id`` (and ``version``), ``start``, ``end``: its place in the original text; ``words``,
    ``pieces``; ``kept_id``: the document in which the run's first piece stays.
    """
    pieces = written(units(docs, id_col=id_col, text_col=text_col, versions=versions), "pieces")
    firsts = pieces.groupBy("h1", "h2").agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "kept_id")
    gone = pieces.join(written(firsts, "first-pieces"), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("kept_id")) | F.col("again"))
    owner = ["id", "version"] if versions else ["id"]
    gone = gone.select(*owner, "at", "start", "end", "words", "kept_id")
    # rows that repeat id and text have their pieces twice; each place counts once
    gone = gone.groupBy(*owner, "at", "start", "end", "words").agg(F.min("kept_id").alias("kept_id"))
    run = F.col("at") - F.dense_rank().over(Window.partitionBy(*owner).orderBy("at"))
    runs = gone.withColumn("run", run).groupBy(*owner, "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").cast("int").alias("words"),
        F.count("*").cast("int").alias("pieces"),
        F.min_by("kept_id", "start").alias("kept_id"),
    )
    return runs.where(F.col("words") >= min_words).drop("run")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its repeated runs, and ``kept_spans``: [start, end) in the original text of what stays.

    A column of that name is replaced. Rows with a null id are cut like others.
    """
    span = "array<struct<start:int,end:int>>"
    gone = repeats(docs, id_col=id_col, text_col=text_col, versions=True, **options).groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    gone = written(gone.select(F.xxhash64("id", "version").alias("at"), F.struct("id", "version").alias("owner"), "gone"), "gone")
    names = [c for c in docs.columns if c != "kept_spans"]
    rows = docs.select(F.struct(*[col(c) for c in names]).alias("row"), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("version"))
    rows = rows.withColumn("key", F.xxhash64("id", "version"))
    same = (F.col("key") == F.col("at")) & F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("version") == F.col("owner.version"))
    text = F.col("row").getField(text_col)
    start = F.struct(F.array().cast(span).alias("out"), F.lit(0).alias("at"))

    def leave(a: Column, s: Column) -> Column:
        kept = F.struct(a["at"].alias("start"), s["start"].alias("end"))
        return F.struct(F.when(s["start"] > a["at"], F.array_append(a["out"], kept)).otherwise(a["out"]).alias("out"), s["end"].alias("at"))

    n = F.length(F.coalesce(text, F.lit("")))
    tail = lambda a: F.when(a["at"] < n, F.array_append(a["out"], F.struct(a["at"].alias("start"), n.alias("end")))).otherwise(a["out"])
    kept = F.aggregate(F.coalesce("gone", F.array().cast(span)), start, leave, tail)
    left = F.array_join(F.transform("kept", lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "")
    changed = F.when(F.col("gone").isNull(), text).otherwise(left)
    joined = rows.join(gone, same, "left").withColumn("kept", kept)
    return joined.select(*[(changed if c == text_col else F.col("row").getField(c)).alias(c) for c in names], F.col("kept").alias("kept_spans"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"), versions=True)
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("words").alias("n_words"), F.col("pieces").alias("n_pieces"), F.col("kept_id").alias("kept_doc_id"))


OP7_SQL = r"""
WITH t AS (
  SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS ver, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|\n') AS hits,
         regexp_split_to_array(coalesce(text, ''), '[\p{L}\p{N}]+|\n') AS gaps
  FROM documents
), k AS (
  SELECT doc_id, ver, i, lower(hits[i]) AS tok, length(gaps[i]) AS gap, length(hits[i]) AS n FROM t, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
), p AS (
  SELECT doc_id, ver, i, tok, n, CAST(sum(gap + n) OVER (PARTITION BY doc_id, ver ORDER BY i) - n AS INTEGER) AS s,
         CASE WHEN tok <> chr(10) THEN list_sum([unicode(c) FOR c IN string_split(tok, '')]) END AS letters,
         lead(tok) OVER (PARTITION BY doc_id, ver ORDER BY i) AS next_tok
  FROM k
), q AS (
  SELECT *, next_tok = chr(10) OR (5 * letters + 3 * lead(letters) OVER (PARTITION BY doc_id, ver ORDER BY i)) % 7 = 0 AS cut FROM p
), w AS (
  SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ver ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece
  FROM q WHERE tok <> chr(10)
), u AS (
  SELECT doc_id, ver, piece, string_agg(tok, ' ' ORDER BY i) AS norm, min(s) AS s, max(s + n) AS e, count(*) AS words FROM w GROUP BY doc_id, ver, piece
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS kept, row_number() OVER (PARTITION BY norm, doc_id, ver ORDER BY s) AS nth FROM u
), g AS (
  SELECT *, piece - row_number() OVER (PARTITION BY doc_id, ver ORDER BY piece) AS run FROM f WHERE doc_id IS DISTINCT FROM kept OR nth > 1
)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_at, CAST(max(e) AS INTEGER) AS end_at, CAST(sum(words) AS INTEGER) AS n_words, CAST(count(*) AS INTEGER) AS n_pieces, arg_min(kept, s) AS kept_doc_id
FROM g GROUP BY doc_id, ver, run HAVING sum(words) >= 20
"""
