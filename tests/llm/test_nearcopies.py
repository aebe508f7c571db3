"""Near-dedup by similarity against brute-force Jaccard of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dimlark.llm import components, nearcopies, simhash
from dimlark.llm.common import written


def plain_groups(texts: dict) -> dict:
    """id -> least id of its component, from all pairs."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                a_, b_ = top(a), top(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: top(i) for i in texts}


@pytest.fixture(scope="module")
def texts():
    """Copies with 0 to 9 changed words of some 100, families without a hub, and a line that most share."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choices(words, k=30))
    out = []
    for base in range(24):
        start = rng.choices(words, k=rng.randint(60, 140))
        for copy in range(12 if base < 4 else 3):
            text = list(start)
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(len(text))] = rng.choice(words)
            start = text if base % 3 == 0 else start
            out.append(" ".join(text) + (f" {line}" if base % 4 else ""))
    out += ["", None, "  \t", "one two", "ONE  two", "one three", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("tile_shingles", [1 << 18, 300])
def test_near_copies_against_all_pairs(spark, texts, tile_shingles, monkeypatch):
    monkeypatch.setitem(nearcopies.similar_links.__kwdefaults__, "tile_shingles", tile_shingles)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in nearcopies.near_copies(docs).collect()}
    assert got == plain_groups(texts)


def test_pairs_at_the_bound_are_proposed():
    """Pairs of a similarity of 0.80 to 0.82: nearly all share a key and lie within the bits."""
    rng = random.Random(8)
    places = nearcopies.key_places(64, 14)
    found = 0
    for _ in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = base[:-13] + [f"x{rng.randrange(10**6)}" for _ in range(13)]
        one, two = (nearcopies.shingle_hashes(" ".join(t).encode(), 5) for t in (base, other))
        shared = len(np.intersect1d(nearcopies.set_of(one), nearcopies.set_of(two)))
        assert 0.78 < shared / (len(one) + len(two) - shared) < 0.83
        fps = np.stack([nearcopies.wide_simhash(h) for h in (one, two)])
        coordinates = nearcopies.block_coordinates(fps, places)
        found += bool((coordinates[0] == coordinates[1]).any()) and int(np.bitwise_count((fps[0] ^ fps[1]).view(np.uint64)).sum()) <= 44
    assert found >= 394


def test_large_buckets_and_groups_in_tiles(spark):
    """A hot bucket cut into tiles joins what plain loops join."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (6, 192), dtype=np.uint8)
    bits = np.concatenate([b ^ (rng.random((80, 192)) < 0.1) for b in base])
    fps = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    df = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fps)], "sig long, f0 long, f1 long, f2 long")
    label = lambda rows: components.components(written(rows, "test-links")).collect()
    for tile_rows in (4096, 16):
        groups = {r["node"]: r["label"] for r in label(nearcopies.loose_links(df, keys=64, key_bits=14, max_bits=44, tile_rows=tile_rows))}
        assert groups == {i: i // 80 * 80 for i in range(480)}


def test_pivot_distances_discard_most_pairs_and_no_near_one():
    """The table holds distances to a pivot's blocks, whose differences sum to no more than the differing bits."""
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (400, 192), dtype=np.uint8)
    near = bits ^ (rng.random(bits.shape) < 0.2)
    fps, others = (np.packbits(b, axis=1, bitorder="little").view(np.uint64) for b in (bits, near))
    table = nearcopies.pivot_table()
    pivot = np.unpackbits(simhash.pivot_fingerprints(3).view(np.uint8), bitorder="little")
    plain = lambda b: (b ^ pivot).reshape(len(b), 48, 4).sum(axis=2, dtype=int)
    apart = lambda a, b: np.bitwise_count(a ^ b).sum(axis=1)
    at, others_at = nearcopies.pivot_distances(fps, table), nearcopies.pivot_distances(others, table)
    assert (apart(at, others_at) == np.abs(plain(bits) - plain(near)).sum(axis=1)).all()
    assert (apart(at, others_at) <= apart(fps, others)).all()
    one, other = np.triu_indices(400, 1)
    assert (apart(at[one], at[other]) > 44).mean() > 0.8
    both, both_at = np.concatenate([fps, others]), np.concatenate([at, others_at])
    i = np.arange(400)
    assert (nearcopies.near_pairs(both_at, both, i, i + 400, 44) == np.flatnonzero(apart(fps, others) <= 44)).all()


@pytest.mark.parametrize("copies", [3, 60])
def test_pairs_beyond_the_bound_by_pivots_are_not_compared(copies):
    """Small and large buckets: what the table puts apart is discarded before its bits are compared."""
    fps = np.random.default_rng(9).integers(0, 1 << 60, (1, 3)).astype(np.uint64).repeat(copies, axis=0)
    bucket = np.zeros(copies, int)
    assert (nearcopies.loose_roots(bucket, fps, 44, nearcopies.pivot_table()) == 0).all()
    tell = np.zeros((24, 256), np.uint8)
    fps[-1, 0] ^= np.uint64(1)
    tell[0, fps[-1, 0] & np.uint64(255)] = 255
    assert (nearcopies.loose_roots(bucket, fps, 7, tell) == [0] * (copies - 1) + [copies - 1]).all()


def test_stage_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.deduplicated(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(plain_groups(texts).values()))


def test_stage_cases(spark):
    rows = [(2, "a b", "x"), (1, "A  b", "y"), (1, "A  b", "y"), (None, "a b", "z"), (None, None, "z"), (3, None, "x"), (4, "", "x"), (None, "c d", "v"), (None, "C d", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string").withColumns({c: F.lit(1) for c in ("id", "version", "label", "row", "key", "own", "n", "first_row", "at")})
    got = nearcopies.deduplicated(docs)
    assert got.columns == docs.columns
    left = [tuple(r)[:3] for r in got.collect()]
    assert {r for r in left if r[0] is not None} == {(1, "A  b", "y"), (3, None, "x")} and len(left) == 3
    assert nearcopies.deduplicated(docs.where(F.lit(False))).isEmpty()


@pytest.mark.parametrize("module", [simhash, nearcopies])
def test_repeated_ids_lose_no_text(spark, module):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    for rows in ([(5, "a"), (5, "b"), (5, "a")], [(5, "a"), (3, "b"), (5, "b")]):
        docs = spark.createDataFrame([(i, words(c)) for i, c in rows], "doc_id long, text string")
        left = sorted((r["doc_id"], r["text"][0]) for r in module.deduplicated(docs).collect())
        assert left == ([(5, "a"), (5, "b")] if rows[1][0] == 5 else [(3, "b"), (5, "a")])
