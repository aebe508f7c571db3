"""Trie of conversation prefixes, screened by a count-min sketch.

A conversation's prefix of d turns has a digest of 120 bits: the exclusive or of its turns'
digests, each taken together with its depth, so it is a running total that is formed for
conversations of any length (``places``), and a prefix's parent follows from it without a lookup.

All prefixes go into a count-min sketch of counts 0, 1 and 2 or more. An estimate never lies below
the count, so an estimate of one proves that a single conversation has the prefix: such nodes, the
tails of conversations, are told where they stand. Only the prefixes that may be shared are
shuffled and grouped exactly, and a false alarm there is a group of one. Of a tail only its first
node is joined, to learn whom its parent is named after.

Sums over a subtree need no walk. A conversation owns the nodes of which it is the smallest
member, and these are its path from some depth on. So a node's children, leaves and repeated
words are sums over its members of what each one owns below, or doesn't own.

The sketch is built in tasks as blocks of bytes, which are merged block by block, and broadcast:
four rows of at most ``MOST_CELLS`` cells of two bits, 16 MB. It follows the number of prefixes up to that; with
many more of them it fills up, and more prefixes go through the grouping, with the same result.

Cases: turns stand by ``turn``, nulls first, then by role and the digest of role and text; null
roles and texts are empty. Rows without a conversation's id belong to none and are left out.
Repeated rows are turns of their own. An empty table has no nodes, not even a root. Other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE_RUN, col, table, written
from .merkle import CRC32, digest
from .places import placed

#: Hash rows of the sketch, cells of a block, and least and most cells of a row.
HASHES, BLOCK = 4, 1 << 16
LEAST_CELLS, MOST_CELLS = 1 << 14, 1 << 24
#: Partial blocks are merged in so many lanes first.
LANES = 64
#: Conversations whose ids are put together at once where many end in one node.
SEGMENT = 4096


def turns_of(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, digest, words)``; no text goes on from here."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return conversations.where(col(id_col).isNotNull()).select(
        col(id_col).cast("long").alias("conv_id"),
        col(turn_col).alias("turn"),
        role.alias("role"),
        digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(NON_SPACE_RUN)).cast("long").alias("words"),
    )


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of another: their turns ``(conv_id, depth, digest, words)``, and all ``conv_id``.

    Conversation c takes its first h turns, h below ``most`` by a hash of c, from c less its remainder by ``every``.
    """
    rows = written(placed(turns, "conv_id", ("turn", "role", "digest"), tag="trie-order").drop("turn", "role"), "trie-turns")
    convs = rows.where("place = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    lenders = rows.where((F.col("place") < most - 1) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "place", "of", "digest", "words")
    own_start = lenders.where("place = 0").select("base", "of")
    convs = written(convs.join(own_start, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("of", F.lit(0))).alias("lent")), "trie-convs")
    own = rows.join(convs, "conv_id").where((F.col("base") == F.col("conv_id")) | (F.col("place") >= F.col("h")))
    depth = F.when(F.col("base") == F.col("conv_id"), F.col("place")).otherwise(F.col("place") - F.col("h") + F.col("lent")) + 1
    lent = convs.where("base <> conv_id").join(lenders.drop("of"), "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    return own.select("conv_id", depth.alias("depth"), "digest", "words").unionByName(lent), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, depth, digest, words)`` with the prefix's digest ``d1, d2``, its parent's ``p1, p2``, the words up to it ``upto``, and the conversation's ``length``."""
    own = digest(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    lane = lambda at: F.conv(F.substring(own, at, 15), 16, 10).cast("long")
    rows = turns.select("conv_id", "depth", "words", lane(1).alias("x1"), lane(16).alias("x2"))
    rows = placed(rows, "conv_id", ("depth",), {"d1": ("x1", "bit_xor"), "d2": ("x2", "bit_xor"), "upto": ("words", "sum")}, tag="trie-depths")
    return rows.select("conv_id", "depth", "words", "upto", F.col("of").alias("length"), "d1", "d2", F.col("d1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("x2")).alias("p2"))


def cells(d1: np.ndarray, d2: np.ndarray, width: int) -> np.ndarray:
    """The cell of each hash row for each digest, numbered through all rows; ``width`` is a power of two."""
    nth = np.arange(HASHES, dtype=np.uint64)[:, None]
    at = (d1.astype(np.uint64) + nth * (d2.astype(np.uint64) | np.uint64(1))) & np.uint64(width - 1)
    return (at + nth * np.uint64(width)).astype(np.int64)


def added(counts: np.ndarray, at: np.ndarray) -> None:
    """One more in each cell of ``at``, as often as it stands there, up to two."""
    place, n = np.unique(at, return_counts=True)
    counts[place] = np.minimum(counts[place] + np.minimum(n, 2).astype(np.uint8), 2)


def packed(counts: np.ndarray) -> np.ndarray:
    """Four cells of two bits a byte."""
    c = counts.reshape(-1, 4)
    return c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6


def at_cells(sketch: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sketch[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3


def sketch_of(rows: DataFrame, width: int) -> np.ndarray:
    """The packed count-min sketch of the digests ``d1, d2``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(HASHES * width, np.uint8)
        seen = 0
        for b in batches:
            added(counts, cells(b.column(0).to_numpy(), b.column(1).to_numpy(), width).ravel())
            seen += b.num_rows
        blocks = counts.reshape(-1, min(BLOCK, counts.size))
        for i in np.flatnonzero(blocks.any(axis=1)):
            data = pa.array([zlib.compress(packed(blocks[i]).tobytes(), 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen % LANES], pa.int32()), data], names=["block", "lane", "data"])

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(BLOCK, HASHES * width), np.uint8)
        for data in parts["data"]:
            cell = np.frombuffer(zlib.decompress(data), np.uint8)
            total = np.minimum(total + (cell[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel(), 2)
        return pd.DataFrame({"block": parts["block"][:1], "lane": parts["lane"][:1], "data": [zlib.compress(packed(total).tobytes(), 1)]})

    kind = "block int, lane int, data binary"
    blocks = rows.select("d1", "d2").mapInArrow(build, kind).groupBy("block", "lane").applyInPandas(merged, kind).groupBy("block").applyInPandas(merged, kind)
    out = np.zeros(HASHES * width // 4, np.uint8)
    for r in blocks.select("block", "data").collect():
        cell = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
        out[r["block"] * len(cell) : (r["block"] + 1) * len(cell)] = cell
    return out


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """``rows`` with ``alone`` and ``parent_alone``: whether the sketch proves that only this conversation has the prefix, or its parent."""
    if width is None:
        width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * rows.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(sketch_of(rows, width))
    names = rows.columns
    at = [names.index(c) for c in ("d1", "d2", "p1", "p2", "depth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for b in batches:
            d1, d2, p1, p2, depth = (b.column(i).to_numpy() for i in at)
            alone = at_cells(sketch, cells(d1, d2, width)).min(axis=0) == 1
            parent = (at_cells(sketch, cells(p1, p2, width)).min(axis=0) == 1) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone), pa.array(parent)], names=[*names, "alone", "parent_alone"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kind}, alone boolean, parent_alone boolean")


def joined_ids(ends: DataFrame) -> DataFrame:
    """``ends(d1, d2, conv_id)`` -> ``(d1, d2, ends_sha256)``: the digest of a node's ids, ascending, comma-joined.

    The ids of a node are put together by segments; only their joined text, of which the digest is, stands whole.
    """
    rows = placed(ends.select(F.struct("d1", "d2").alias("node"), "conv_id"), "node", ("conv_id",), tag="trie-ends")
    parts = rows.groupBy("node", F.floor(F.col("place") / SEGMENT).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    whole = parts.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]), ",").alias("ids"))
    return whole.select("node.d1", "node.d2", digest(F.col("ids")).alias("ends_sha256"))


def trie(turns: DataFrame, convs: DataFrame, *, width: int | None = None) -> DataFrame:
    """A row for each node of the trie of ``turns(conv_id, depth, digest, words)``; ``convs``: every ``conv_id``, also those without turns.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (words that the subtree repeats) and ``ends_sha256``.
    """
    zero, none = F.lit(0).cast("long"), digest(F.lit(""))
    rows = written(screened(written(prefixes(turns), "trie-prefixes"), width), "trie-screened")
    first = convs.agg(F.min("conv_id")).first()[0]
    root_id = F.lit(first).cast("long")

    shared = rows.where(~F.col("alone"))
    groups = shared.groupBy("d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"))
    shared = written(shared.join(written(groups, "trie-groups"), ["d1", "d2"]), "trie-shared")
    lost = F.col("owner") != F.col("conv_id")
    at_end = F.col("depth") == F.col("length")
    tells = shared.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(lost, F.col("depth"))), zero).alias("foreign"),
        F.coalesce(F.max(F.when(lost, F.col("upto"))), zero).alias("foreign_words"),
        F.coalesce(F.max(F.when(at_end, (~lost & (F.col("n_convs") == F.col("n_ends"))).cast("long"))), F.lit(1).cast("long")).alias("leaf"),
    )
    tells = written(tells, "trie-tells")
    members = shared.join(tells, "conv_id")
    nodes = members.groupBy("d1", "d2").agg(
        F.min("owner").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("n_convs").alias("n_convs"),
        F.count_if(~at_end & (F.col("depth") >= F.col("foreign"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(zero, F.col("foreign_words") - F.col("upto") + F.col("words"))).alias("saved_tokens"),
    )
    nodes = written(nodes.join(joined_ids(shared.where(at_end).select("d1", "d2", "conv_id")), ["d1", "d2"], "left"), "trie-nodes")
    ended = F.when(at_end, digest(F.col("conv_id").cast("string"))).otherwise(none)
    tails = rows.where("alone").select("conv_id", "depth", "p1", "p2", F.lit(1).cast("long").alias("n_convs"), (~at_end).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), ended.alias("ends_sha256"), "parent_alone")
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    local = tails.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id"))
    asking = tails.where("NOT parent_alone").drop("parent_alone").unionByName(nodes.drop("d1", "d2"))
    owners = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # what has no group above it at depth two or more stands below a node that is alone, so its own conversation's
    below = asking.where("depth > 1").join(owners, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    top = asking.where("depth = 1").withColumn("parent_conv_id", root_id)
    lengths = rows.where("depth = 1").select("conv_id", "length")
    every = convs.join(lengths, "conv_id", "left").join(tells, "conv_id", "left")
    turnless = convs.join(lengths, "conv_id", "left_anti").select(F.lit(0).alias("d1"), F.lit(0).alias("d2"), "conv_id")
    has_turns = F.col("length").isNotNull()
    root = every.agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(has_turns & (F.coalesce("foreign", zero) == 0)).alias("n_children"),
        F.greatest(F.lit(1).cast("long"), F.coalesce(F.sum(F.when(has_turns, F.coalesce("leaf", F.lit(1)))), zero)).alias("n_leaves"),
        F.coalesce(F.sum("foreign_words"), zero).alias("saved_tokens"),
    ).where("n_convs > 0")
    root = root.withColumns({"depth": zero, "parent_conv_id": F.lit(None).cast("long"), "d1": F.lit(0)}).join(joined_ids(turnless).drop("d2"), "d1", "left")
    parts = [df.withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(*out) for df in (local, below, top, root)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(turns_of(table(spark, sf_dir, "conversations")))
    return trie(turns, convs)


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list(said ORDER BY i) AS said, {CRC32.format(id="c")} % 4 AS h FROM t GROUP BY c
), r AS (
  SELECT o.c, coalesce(b.said, [])[1 : CAST(o.h AS BIGINT)] || o.said[CAST(o.h AS BIGINT) + 1 :] AS said FROM o LEFT JOIN o b ON b.c = o.c - o.c % 20
), p AS (
  SELECT c, d, said[1:d] AS path, len(said) = d AS ended FROM r, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS d)
), n AS (
  SELECT path, d, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM p GROUP BY path, d
), k AS (
  SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), s AS (
  SELECT n.path[1:a] AS path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n LEFT JOIN k USING (path), LATERAL (SELECT unnest(range(0, n.d + 1)) AS a) GROUP BY 1
)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n u ON n.d > 0 AND u.path = n.path[1 : n.d - 1]
"""
