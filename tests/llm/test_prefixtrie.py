"""The prefix trie against a plain one in Python, with a sketch wide enough and far too narrow."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimlark.llm import prefixtrie

KIND = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role, sha(f"{len(role.encode())}:{role}{text}"), text))
    own = {c: [(x[1], x[3]) for x in sorted(said)] for c, said in own.items()}
    base = lambda c: c - int(np.fmod(c, 20))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(base(c), [])[: h[c]] + own[c][h[c] :] for c in own}


def plain_trie(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * (len(path[-1][1].split()) if path else 0)
    return sorted(
        (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path], saved[path], sha(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))))
        for path, who in members.items()
    )


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple(-(10**12) if x is None else x for x in r))


def said(dice, n):
    return [(i if dice.random() < 0.9 else None, dice.choice(["user", "assistant", None]), dice.choice([None, "", "yes", "no no", "a b c"])) for i in range(n)]


def rows_of(seed, convs=90, turns=6):
    dice = random.Random(seed)
    rows = [(c, *x) for c in dice.sample(range(-70, 400), convs) for x in said(dice, dice.randrange(1, turns))]
    copied = said(dice, 4)
    rows += [(c, *x) for c in range(1000, 1060) for x in copied]
    rows += [(None, 0, "user", "of nobody"), rows[0], rows[0]]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, None])
def test_against_a_plain_trie(spark, width):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("place", "of", "digest", "depth", "d1", "alone", "owner", "nth", "stretch")})
    turns, convs = prefixtrie.rebuilt(prefixtrie.turns_of(df))
    assert found(prefixtrie.trie(turns, convs, width=width)) == plain_trie(plain_rebuilt(rows))


def test_a_long_conversation_long_texts_and_no_rows(spark, tmp_path):
    rows = [(20, i, "user", "word " * (i % 3)) for i in range(160)] + [(21, i, "user", "word " * (i % 3)) for i in range(130)] + [(23, 0, "user", "x " * 400_000), (41, 0, None, None)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(prefixtrie.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(plain_rebuilt(rows))
    turns, convs = prefixtrie.rebuilt(prefixtrie.turns_of(spark.createDataFrame([], KIND)))
    assert found(prefixtrie.trie(turns, convs)) == []


def test_all_conversations_without_turns(spark):
    convs = spark.createDataFrame([(7,), (10,), (9,)], "conv_id long")
    turns = spark.createDataFrame([], "conv_id long, depth long, digest string, words long")
    assert found(prefixtrie.trie(turns, convs)) == [(7, 0, None, 3, 0, 1, 0, sha("7,9,10"))]


def test_the_sketch_never_tells_too_little():
    dice = np.random.default_rng(1)
    d1, d2 = dice.integers(0, 1 << 60, (2, 3000))
    counts = np.zeros(prefixtrie.HASHES * 1024, np.uint8)
    for part in range(3):
        prefixtrie.added(counts, prefixtrie.cells(d1[part::3], d2[part::3], 1024).ravel())
    prefixtrie.added(counts, prefixtrie.cells(d1[:500], d2[:500], 1024).ravel())
    told = prefixtrie.at_cells(prefixtrie.packed(counts), prefixtrie.cells(d1, d2, 1024)).min(axis=0)
    assert (told[:500] == 2).all() and (told >= 1).all()
    wide = np.zeros(prefixtrie.HASHES * 32768, np.uint8)
    prefixtrie.added(wide, prefixtrie.cells(d1, d2, 32768).ravel())
    assert (prefixtrie.at_cells(prefixtrie.packed(wide), prefixtrie.cells(d1, d2, 32768)).min(axis=0) == 1).mean() > 0.99
