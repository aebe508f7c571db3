"""SimHash near-duplicates of a similarity: wide fingerprints propose, word shingles decide.

The links of ``simhash`` are few differing bits. Texts of a Jaccard similarity of 0.8 differ in
some 15 of 100 bits, so here the fingerprint is wider and the bound on bits is loose:

1. A text's set holds the hashes of its runs of ``shingle`` words. Its fingerprint has 192
   majority bits; texts of equal sets share one and are one node from here on.
2. Nodes meet under ``keys`` block coordinates, as in ``simhash``: a block is ``key_bits`` places of
   the fingerprint, and its distances to the pivots 0, 1, 11, ... within the block are written as its
   bits. Pairs that meet are discarded by a pivot distance table: the distances of each 4 bits to
   those of a pivot. By the triangle inequality the differences of a pair's distances sum to no
   more than its differing bits. Survivors within ``max_bits`` are joined into loose groups; a
   task gives a forest, not pairs.
3. Within a loose group the sets themselves are compared: nodes are linked at ``percent`` or more.
   Large groups are cut into tiles, so that every two sets of a group meet, in bounded memory.

What step 3 says is exact. A pair can only be missed in step 2: at a similarity of exactly 0.8,
two texts of many words meet with a chance of 0.999 and lie within 44 bits with a chance of
0.999, and more similar ones surely; for texts of less than ten words it is 0.9 at worst. The
table loses none. Distances to whole pivots, as in ``simhash``, would discard nothing at so wide a
bound (they differ by less than 44 for nearly all pairs); those of 4 bits tell most pairs apart.

Cases: a text of fewer words is one shingle; null and empty texts have the empty set and are
linked. Null ids rank last; rows that repeat an id count by their texts. Of equal rows one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, written
from .components import components
from .simhash import BYTE_BITS, XXH_SEED, grouped, kept_rows, pivot_fingerprints, tiled, whole_buckets

#: 64-bit words of a fingerprint.
FP_WORDS = 3
#: Buckets up to this size are compared all at once, by shifts of the sorted rows.
SMALL = 24
#: Rows of a larger bucket that are compared with the rest at once.
ROWS_AT_ONCE = 128


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """A row of 24 bytes for each distinct shingle, in order of the first 8."""
    words = text.lower().split()
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    runs = {joined[a:b] for a, b in zip(starts.tolist(), last.tolist(), strict=False)}
    wide, narrow = xxhash.xxh3_128_digest, xxhash.xxh64_digest
    rows = np.frombuffer(b"".join(wide(r, XXH_SEED) + narrow(r, XXH_SEED) for r in runs), np.uint8).reshape(len(runs), 8 * FP_WORDS)
    return rows[np.argsort(np.ascontiguousarray(rows[:, :8]).view("<i8")[:, 0])] if len(rows) else rows


def set_of(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes[:, :8]).view("<i8")[:, 0]


def signature(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes(), XXH_SEED) - (1 << 63)


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """The majority bits of the rows, as FP_WORDS signed integers."""
    n, width = hashes.shape
    counts = np.bincount((hashes + 256 * np.arange(width)).ravel(), minlength=256 * width).reshape(width, 256) @ BYTE_BITS
    return np.packbits((2 * counts.ravel() > n).astype(np.uint8), bitorder="little").view("<i8")


def prints_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, version, sig, f0, f1, f2)`` for each row: the text's hash, the set's signature, and its fingerprint."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("version"), col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, fps = [], np.zeros((batch.num_rows, FP_WORDS), np.int64)
            for i, text in enumerate(batch.column(2)):
                hashes = shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle)
                sigs.append(signature(set_of(hashes)))
                fps[i] = wide_simhash(hashes)
            own = [np.ascontiguousarray(fps[:, w]) for w in range(FP_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.int64()), *map(pa.array, own)], names=["id", "version", "sig", "f0", "f1", "f2"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, version long, sig long, f0 long, f1 long, f2 long")


def block_coordinates(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each fingerprint and each row of ``places``: the key's number and the block's distances to its pivots, as bits."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    keys, width = places.shape
    out = np.zeros((len(fps), keys), np.int64)
    for i in range(width):
        out |= bits[:, places[:, i]].astype(np.int64) << i
    return out + (np.arange(keys) << width)


def key_places(keys: int, key_bits: int) -> np.ndarray:
    """The places of each key's block, by a seeded draw."""
    rng = np.random.default_rng(XXH_SEED)
    return np.array([rng.choice(64 * FP_WORDS, key_bits, replace=False) for _ in range(keys)])


def meeting_rows(distinct: DataFrame, keys: int, key_bits: int) -> DataFrame:
    """``distinct(sig, f0, f1, f2)`` -> a row ``(key, sig, f0, f1, f2)`` for each key."""
    places = key_places(keys, key_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = np.stack([part.column(i).to_numpy() for i in range(1, 1 + FP_WORDS)], axis=1)
                owner = pa.array(np.repeat(np.arange(len(fps)), keys))
                yield pa.RecordBatch.from_arrays([pa.array(block_coordinates(fps, places).ravel()), *part.take(owner).columns], names=["key", "sig", "f0", "f1", "f2"])

    return distinct.select("sig", "f0", "f1", "f2").mapInArrow(run, "key long, sig long, f0 long, f1 long, f2 long")


def pivot_table() -> np.ndarray:
    """For each byte of a fingerprint and each value of it: the distances of both its 4-bit blocks to the pivot's, in unary."""
    pivot = pivot_fingerprints(FP_WORDS).view(np.uint8)
    apart = pivot[:, None] ^ np.arange(256, dtype=np.uint8)
    unary = lambda block: (1 << np.bitwise_count(block)) - 1
    return (unary(apart & 15) | unary(apart >> 4) << 4).astype(np.uint8)


def pivot_distances(fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The coordinates of each fingerprint: as they are unary, their differences are differing bits."""
    return table[np.arange(8 * FP_WORDS), np.ascontiguousarray(fps).view(np.uint8)].view(np.uint64)


def joined_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least row reachable from each of n rows by links a-b."""
    root = np.arange(n) if root is None else root
    while len(a) and (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b], a, b):
            np.minimum.at(root, side, low)
        root = root[root]
    return root


def near_pairs(at: np.ndarray, fps: np.ndarray, one: np.ndarray, other: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (one[i], other[i]) lie within ``max_bits``: coordinates ``at`` first, then distances."""
    left = np.flatnonzero(np.bitwise_count(at[one] ^ at[other]).sum(axis=1) <= max_bits)
    return left[np.bitwise_count(fps[one[left]] ^ fps[other[left]]).sum(axis=1) <= max_bits]


def loose_roots(bucket: np.ndarray, fps: np.ndarray, max_bits: int, table: np.ndarray) -> np.ndarray:
    """For rows sorted by bucket: the row that stands for those that bits within ``max_bits`` join in its bucket."""
    n, at = len(fps), pivot_distances(fps, table)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    small = np.repeat(size <= SMALL, size)
    ones, others = [], []
    for shift in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & small[shift:])
        i = i[near_pairs(at, fps, i, i + shift, max_bits)]
        ones.append(i)
        others.append(i + shift)
    root = joined_roots(n, np.concatenate([*ones, first[:0]]), np.concatenate([*others, first[:0]]))
    for start, count in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own, coordinates, stand = fps[start : start + count], at[start : start + count], np.arange(count)
        for row in range(0, count, ROWS_AT_ONCE):
            apart = sum(np.bitwise_count(coordinates[row : row + ROWS_AT_ONCE, None, w] ^ coordinates[None, row:, w]).astype(np.int16) for w in range(FP_WORDS))
            a, b = np.nonzero(apart <= max_bits)
            a, b = a + row, b + row
            near = np.bitwise_count(own[a] ^ own[b]).sum(axis=1) <= max_bits
            stand = joined_roots(count, a[near], b[near], stand)
        root[start : start + count] = start + stand
    return root


def loose_links(distinct: DataFrame, *, keys: int, key_bits: int, max_bits: int, tile_rows: int = 4096) -> DataFrame:
    """``(a, b)``: signatures, joined within each bucket."""
    table = pivot_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in whole_buckets(batches):
            sig = rows.column(2).to_numpy()
            fps = np.stack([rows.column(i).to_numpy() for i in range(3, 3 + FP_WORDS)], axis=1).view(np.uint64)
            root = loose_roots(bucket, fps, max_bits, table)
            linked = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.unique(np.stack([sig[root[linked]], sig[linked]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return tiled(meeting_rows(distinct, keys, key_bits), "key", "sig", tile_rows).mapInArrow(run, "a long, b long")


def thinned(links: DataFrame) -> DataFrame:
    """``(a, b)`` with a < b -> links of the same components, one for each b and few besides.

    A node of many buckets hangs on the least of its ends there, and those ends hang on it too.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    rows = links.distinct().withColumn("least", least)
    own, ends = rows.select(F.col("least").alias("a"), "b"), rows.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return own.union(ends).distinct()


def similar_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the one that stands for all that links of ``percent`` or more reach."""
    n, root = len(sets), np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_inverse=True)
    edges = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(n), sizes)
    by_code = np.argsort(codes, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(codes))] if len(codes) else np.zeros(1, int)
    holders = owner[by_code]
    waiting = np.ones(n, bool)
    for stand in range(n):
        if not waiting[stand]:
            continue
        waiting[stand], reached = False, [stand]
        while reached and waiting.any():
            x = reached.pop()
            met = [holders[ends[c] : ends[c + 1]] for c in codes[edges[x] : edges[x + 1]]]
            overlap = np.bincount(np.concatenate(met), minlength=n) if met else np.zeros(n, int)
            near = np.flatnonzero(waiting & (overlap * (100 + percent) >= (sizes[x] + sizes) * percent))
            root[near], waiting[near] = stand, False
            reached.extend(near.tolist())
    return root


def similar_links(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, shingle: int, percent: int, tile_shingles: int = 1 << 17) -> DataFrame:
    """``wanted(first_row, sig, label)`` -> ``(a, b)``: links that join all sets of a label that are ``percent`` similar.

    The sets come from the texts, which are read again; ``first_row`` is a hash of id and text.
    """
    rows = docs.select(F.xxhash64(col(id_col), F.xxhash64(col(text_col))).alias("row"), col(text_col).cast("binary").alias("text"))
    rows = rows.join(wanted, F.col("row") == F.col("first_row")).select("label", "sig", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, own, found = [], [], []
            for i, text in enumerate(batch.column(2)):
                members = set_of(shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle))
                if signature(members) == batch.column(1)[i].as_py():  # else a row of the same hash
                    label.append(batch.column(0)[i].as_py())
                    own.append(batch.column(1)[i].as_py())
                    found.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(own, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.binary())], names=["label", "sig", "size", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in whole_buckets(batches):
            sig, members = table.column(2).to_numpy(), table.column(4)
            a, b = [], []
            for start, end in zip(first := np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), np.r_[first[1:], len(bucket)], strict=True):
                root = similar_roots([np.frombuffer(members[int(i)].as_buffer(), "<i8") for i in range(start, end)], percent) + start
                linked = np.flatnonzero(root != np.arange(start, end))
                a.append(sig[root[linked]])
                b.append(sig[start + linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    members = written(rows.mapInArrow(sets, "label long, sig long, size long, members binary").dropDuplicates(["sig"]), "shingle-sets")
    return tiled(members, "label", "sig", 8 * tile_shingles, "size").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, keys: int = 64, key_bits: int = 14, max_bits: int = 44) -> DataFrame:
    """``(id, version, sig, label, component)`` for each row; component: the smallest id reachable by links of ``percent`` or more."""
    prints = written(prints_of(docs, id_col, text_col, shingle), "wide-fingerprints")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "version")
    distinct = prints.groupBy("sig").agg(F.min(rank).alias("best"), *[F.min(c).alias(c) for c in ("f0", "f1", "f2")])
    distinct = written(distinct.select("sig", F.col("best.id").alias("first"), F.xxhash64("best.id", "best.version").alias("first_row"), "f0", "f1", "f2"), "distinct-sets")
    loose = components(thinned(written(loose_links(distinct, keys=keys, key_bits=key_bits, max_bits=max_bits), "loose-links")))
    wanted = written(distinct.join(loose, distinct["sig"] == loose["node"]).select("first_row", "sig", "label"), "loose-members")
    links = written(similar_links(docs, wanted, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent), "similar-links")
    return grouped(prints, distinct, components(thinned(links)), "sig")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies: see ``kept_rows``."""
    return kept_rows(docs, near_copies(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)
