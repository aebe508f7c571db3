"""The Merkle manifest against a plain tree in Python, with sources beyond one block of leaves."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dimlark.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(level):
    """The root, and for each leaf its (left, right) siblings upwards."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            b = a - a % 3
            paths[i].append(("".join(level[b:a]), "".join(level[a + 1 : b + 3])))
        at = [a // 3 for a in at]
        level = [sha("".join(level[b : b + 3])) for b in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    """What op12 returns, as a sorted list of tuples."""
    by = defaultdict(list)
    for r in rows:
        leaf = plain_leaf(r, r["text"])
        tampered = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        by[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf, plain_leaf(r, r["text"].replace("\n", "")) if tampered else leaf, r["doc_id"]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(by[s])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        subroot, paths = trees[s]
        for (_, leaf, shown, doc_id), path in zip(sorted(by[s]), paths, strict=True):
            cur = shown
            for left, right in path + top:
                cur = sha(left + cur + right)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), cur, cur == root))
    return sorted(out, key=str)


def found(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 729, None: 2, "Z": 3, "é": 4}, {"a": 730}, {"hot": 2300, "b": 27, "c": 28, "d": 1}])
def test_against_a_plain_tree(spark, tmp_path, sizes):
    dice = random.Random(5)
    rows = [
        {"doc_id": dice.choice([None, *range(90)]) if dice.random() < 0.1 else dice.randrange(10**9), "text": dice.choice([None, "", "one\ntwo", "naïve\n" * 3, "plain"]), "lang": dice.choice([None, "en"]), "source": s, "n_chars": dice.choice([None, 7])}
        for s, n in sizes.items()
        for _ in range(n)
    ]
    dice.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("key", "place", "node", "item", "levels", "nth", "stretch", "of")})
    got = found(spark, docs, tmp_path)
    assert got == plain(rows)
    if len(rows) > 100:
        assert {r[-1] for r in got} == {True, False}


def test_repeated_rows_long_texts_and_no_rows(spark, tmp_path):
    row = {"doc_id": 4, "text": "a\n" * 300_000, "lang": "en", "source": "s", "n_chars": 1}
    rows = [row] * 800 + [{**row, "doc_id": 5, "text": "b"}]
    docs = spark.createDataFrame([rows[-1]], DOCS).unionByName(spark.range(800).select(F.lit(4).cast("long").alias("doc_id"), F.repeat(F.lit("a\n"), 300_000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    assert found(spark, docs, tmp_path) == plain(rows)
    assert found(spark, docs.limit(0), tmp_path / "none") == []
