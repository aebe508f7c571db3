"""SimHash near-duplicates: 64-bit fingerprints, linked by pivot distance tables.

A fingerprint's coordinates are its Hamming distances to reference fingerprints (pivots). By
the triangle inequality, two fingerprints within ``max_bits`` differ by no more than that in
any coordinate. Two sets of pivots are used:

* The bits are cut into ``max_bits + 2`` blocks. A block's pivots are its patterns 0, 1, 11,
  111, ...; the distances to them, taken within the block, tell its bits. A pair within
  ``max_bits`` has different coordinates in ``max_bits`` blocks at most, so those of two whole
  blocks are equal: fingerprints meet under each pair of blocks, by an equi-join on their
  coordinates, which the block's bits write down shortest. No pair within the bound is missed.
* ``pivots`` whole fingerprints: pairs that meet are discarded when some coordinate differs by
  more than ``max_bits``, and the survivors are verified by their Hamming distance.

Only distinct fingerprints meet. A key that more than ``tile_rows`` share is cut into chunks,
and every two chunks meet in a task of their own, so no task holds more than two chunks and no
pair is lost. A task gives a spanning forest of the links it found, not all pairs.

Cases: a null text has no words, like an empty one; all such documents have fingerprint zero
and are linked. Null ids get a component but never name one, unless a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, table, written
from .components import components

XXH_SEED = 42
#: bits of each byte value, lowest first
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Buckets up to this size are compared pair by pair, all buckets of a batch at once.
SMALL = 24
#: Hot keys are broadcast up to this many; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 10_000


def simhash64(text: bytes, shingle: int) -> int:
    """The majority bits of the XXH64 of all shingles, repeats included, as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], XXH_SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype="<u8")
    places = hashes.view(np.uint8).reshape(n, 8) + 256 * np.arange(8)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    bits = (2 * counts.ravel() > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, version, fp)`` for each row, with the text's hash as ``version``: no shuffle, whole texts."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("version"), col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash64(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "version", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, version long, fp long")


def block_ranges(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def meeting_keys(fp: Column, max_bits: int) -> Column:
    """For each pair of blocks: a number for the pair and the coordinates within both."""
    cut = block_ranges(max_bits + 2)
    bits = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in cut]
    pairs = list(combinations(range(len(cut)), 2))
    return F.array(*[F.lit(k << 48) + F.shiftleft(bits[i], cut[j][1]) + bits[j] for k, (i, j) in enumerate(pairs)])


def pivot_fingerprints(pivots: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, XXH_SEED) for i in range(pivots)], dtype=np.uint64)


def near(table_: np.ndarray, fps: np.ndarray, one: np.ndarray, other: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (one[i], other[i]) lie within ``max_bits``: coordinates first, then distances."""
    left = np.arange(len(other))
    for coordinate in table_:
        if not len(left):
            return left
        left = left[np.abs(coordinate[one[left] if len(one) > 1 else one] - coordinate[other[left]]) <= max_bits]
    return left[np.bitwise_count(fps[one[left] if len(one) > 1 else one] ^ fps[other[left]]) <= max_bits]


def forest(bucket: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> np.ndarray:
    """For rows sorted by bucket: the row that stands for each row's links within its bucket."""
    table_ = np.bitwise_count(fps[None, :] ^ pivots[:, None]).astype(np.int8)
    n = len(fps)
    root = np.arange(n)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    small = np.repeat(size <= SMALL, size)
    ones, others = [], []
    for shift in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & small[shift:])
        if not len(i):
            break
        kept = near(table_, fps, i, i + shift, max_bits) if len(i) > 1 else i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= max_bits]
        kept = i[kept] if len(i) > 1 else kept
        ones.append(kept)
        others.append(kept + shift)
    if ones:
        a, b = np.concatenate(ones), np.concatenate(others)
        while len(a) and (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
    for start, count in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rest = np.arange(start, start + count)
        while len(rest):
            stand, reached, rest = rest[0], [rest[0]], rest[1:]
            while reached and len(rest):
                hits = near(table_, fps, np.array([reached.pop()]), rest, max_bits)
                root[rest[hits]] = stand
                reached.extend(rest[hits])
                rest = np.delete(rest, hits)
    return root


def tiled(keys: DataFrame, by: str, node: str, tile_rows: int, weight: str | None = None) -> DataFrame:
    """``keys`` sorted by ``by``, ``tile`` and ``node`` within tasks; every two rows of a key meet in some tile.

    A key of more than ``tile_rows`` rows (or so much of ``weight``) is cut into chunks by a hash of
    ``node``, and every two chunks share a tile.
    """
    size = F.sum(weight) if weight else F.count("*")
    hot = written(keys.groupBy(by).agg(size.alias("n")).where(F.col("n") > tile_rows).select(by, F.ceil(F.col("n") / tile_rows).alias("chunks")), "hot-keys")
    n_hot = hot.count()
    columns = [c for c in keys.columns if c != by]
    if n_hot:
        keys = keys.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, by, "left")
        mine = F.pmod(F.xxhash64(node), F.col("chunks"))
        met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.least(k, mine) * F.col("chunks") + F.greatest(k, mine))
        tile = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(met))
    else:
        tile = F.lit(0).cast("long")
    return keys.select(by, tile.alias("tile"), *columns).repartition(by, "tile").sortWithinPartitions(by, "tile", node)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first two columns, key and tile, in tables that part no bucket; each row's bucket, as a number."""
    held: list[pa.RecordBatch] = []
    ends = lambda batch, i: (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())

    def told() -> tuple[np.ndarray, pa.Table]:
        rows = pa.Table.from_batches(held)
        key, tile = (rows.column(i).to_numpy() for i in (0, 1))
        return np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]) - 1, rows

    for batch in batches:
        if not batch.num_rows:
            continue
        key, tile = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        change = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
        if len(change):
            held.append(batch.slice(0, change[-1] + 1))
            yield told()
            held, batch = [], batch.slice(change[-1] + 1)
        elif held and ends(held[-1], -1) != ends(batch, 0):
            yield told()
            held = []
        held.append(batch)
    if held:
        yield told()


def links(distinct: DataFrame, *, max_bits: int = 4, pivots: int = 16, tile_rows: int = 4096) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that join all fingerprints within ``max_bits`` of each other."""
    keys = distinct.select(F.explode(meeting_keys(F.col("fp"), max_bits)).alias("key"), "fp")
    pivot_fps = pivot_fingerprints(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in whole_buckets(batches):
            fp = rows.column(2).to_numpy()
            root = forest(bucket, fp.view(np.uint64), pivot_fps, max_bits)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[root[linked]]), pa.array(fp[linked])], names=["a", "b"])

    return tiled(keys, "key", "fp", tile_rows).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``(id, version, fp, label, component)`` for each row.

    ``component``: the smallest id reachable by links; ``label``: the least fingerprint reachable,
    which tells groups apart whose smallest ids are equal; ``version``: the text's hash.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = components(written(links(distinct.select("fp"), max_bits=max_bits), "near-links"))
    return grouped(prints, distinct, labels, "fp")


def grouped(prints: DataFrame, distinct: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """``prints`` with the ``label`` of each row's group and the ``component``, its smallest id."""
    members = written(distinct.join(labels, distinct[node] == labels["node"], "left").select(node, "first", F.coalesce("label", node).alias("label")), "members")
    least = written(members.groupBy("label").agg(F.min("first").alias("component")), "least")
    by_node = written(members.join(least, "label").select(node, "label", "component"), "node-components")
    return prints.join(by_node, node).select("id", "version", node, "label", "component")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies: see ``kept_rows``."""
    return kept_rows(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``label`` of ``found(id, version, label)``: that with the smallest id.

    Null ids rank last; of rows with equal ids that with the smallest text hash stays, and of rows
    equal in both the one whose columns hash lowest.
    """
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "version")
    kept = found.groupBy("label").agg(F.min(rank).alias("best"), F.count("*").alias("n")).select("best.id", "best.version", "n")
    kept = written(kept.groupBy("id", "version").agg(F.max("n").alias("n")).select(F.xxhash64("id", "version").alias("key"), F.struct("id", "version").alias("own"), "n"), "kept-rows")
    names = docs.columns
    rows = docs.select(F.struct(*[col(c) for c in names]).alias("row"), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("version"))
    rows = rows.withColumn("at", F.xxhash64("id", "version"))
    same = (F.col("at") == F.col("key")) & F.col("id").eqNullSafe(F.col("own.id")) & (F.col("version") == F.col("own.version"))
    met = rows.join(kept, same)
    # only a row of a group can stand in the table twice
    lone = met.where("n = 1").select("row")
    first = F.row_number().over(Window.partitionBy("at", "id", "version").orderBy(F.xxhash64("row")))
    again = met.where("n > 1").withColumn("place", first).where("place = 1").select("row")
    return lone.union(again).select(*[F.col("row").getField(c).alias(c) for c in names])


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
