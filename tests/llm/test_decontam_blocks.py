"""Decontamination in several blocks: one automaton at a time, long items in pieces, null item ids."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from dimlark.llm import decontam


def test_blocks_are_bounded_and_whole(spark):
    rng = random.Random(8)
    rows = [(str(i), " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 40, 200])))) for i in range(30)]
    blocks = decontam.item_blocks(spark.createDataFrame(rows, "item_id string, text string"), "item_id", "text", 50, 10)
    got = blocks.collect()
    size, windows = {}, {}
    for r in got:
        words = bytes(r["words"]).decode().split()
        size[r["block"]] = size.get(r["block"], 0) + len(words)
        windows.setdefault(r["item"], set()).update(tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9)))
    assert len(size) > 10 and max(size.values()) <= 50
    assert windows == {i: {tuple(t.split()[k : k + 10]) for k in range(max(1, len(t.split()) - 9))} for i, t in rows}


def test_one_automaton_at_a_time_and_same_hits(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.choice([4, 30, 300])))) for i in range(12)]
    docs = [(i, " ".join(rng.choice("abcdefz") for _ in range(30)) + " " + items[i % 12][1][5:200]) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*docs, docs[0], (None, None), (98, "")], "doc_id long, text string").withColumn("items", F.lit("x"))
    told = lambda n: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontam.scan(docs, bench, block_words=n).collect())
    assert told(60) == told(500_000)


def test_null_item_ids_hit_without_an_id(spark):
    bench = spark.createDataFrame([(None, "secret passage of the test"), (7, "other words here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so a Secret passage, of the test is here and more words follow it")], "doc_id long, text string")
    for block_words in (500_000, 5):
        row = decontam.scan(docs, bench, block_words=block_words).first()
        assert (row["n_hit"], row["items"]) == (5, [])
        assert "passage" not in decontam.decontaminated(docs, bench, block_words=block_words).first()["text"]
    assert decontam.scan(docs, bench, null_items=False).first()["n_hit"] == 0
