"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into hash blocks for each source, 4,096 or as many as hold some ``BLOCK_ROWS`` rows. A source's target in words is met
by whole passes over its blocks and a partial one, which takes blocks in a permuted order and
cuts the last block's last document. That fixes a quota of block draws for each source.

The quotas of all sources stand at the root of a binary tree. A node gives one of its halves
an exact multivariate-hypergeometric share of its draws, source by source, by inversion of a
repeatable uniform number, and the other half the rest; the leaves are the output shards. So
shards get equal numbers of draws, and each source's draws add up to its quota. A source's
block draws are permuted once, and the shards take disjoint runs of them. Within a shard,
documents are ordered by a hash.

Everything is DataFrame work: totals are partial aggregates, windows run within a block or
over one row for each block of a source, and the tree holds one number for each source and
shard, so sources may be many thousands, but not a good part of the rows. All is repeatable for
the same rows.

What a document is taken is the sum over its draws, as the tree dealt them.

Cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
weighed last; rows with equal ids, or none, are spread over the blocks by their texts, so only
rows that agree in id and text share a block. Sources of size 0 have target 0. An empty
table gives an empty mix. Input columns named like outputs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE_RUN, col, table, written

LEAST_SHARDS = 64
LEAST_BLOCKS, BLOCK_ROWS = 4096, 4096
INTERNAL = ("size", "source_size", "target", "taken", "draws")


def md5_number(text: Column, at: int, digits: int) -> Column:
    """Hex digits of the MD5, from place ``at``, as a number."""
    return F.conv(F.substring(F.md5(text), at, digits), 16, 10).cast("long")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``, by inversion of ``u`` in [0, 1).

    Weights run over the support within 12 standard deviations; what lies outside is below 1e-30.
    """
    mean = drawn * marked / total
    spread = F.sqrt(mean * (1 - marked / total) * (total - drawn) / F.greatest(total - 1, F.lit(1))) * 12 + 12
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - total, F.floor(mean - spread))
    high = F.least(marked, drawn, F.ceil(mean + spread))
    support = F.sequence(low, high)
    after = lambda p, k: p * (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))
    weight = F.aggregate(
        support,
        F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct(after(a["p"], k).alias("p"), (a["sum"] + a["p"]).alias("sum")),
        lambda a: a["sum"],
    )
    below = F.aggregate(
        support,
        F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), (weight * u).alias("bar")),
        lambda a, k: F.struct(after(a["p"], k).alias("p"), (a["sum"] + a["p"]).alias("sum"), (a["n"] + (a["sum"] + a["p"] <= a["bar"]).cast("int")).alias("n"), a["bar"].alias("bar")),
        lambda a: a["n"],
    )
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("long")).when(drawn == total, marked).otherwise(F.least(low + below, high))


def shard_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """``sources(key, quota)`` -> ``(key, upto)``: after each shard, how many of the source's draws are dealt."""
    levels = shards.bit_length() - 1
    rows = sources.agg(F.sort_array(F.collect_list(F.struct("key", "quota"))).alias("all"))
    nodes = rows.select(F.lit(1).cast("long").alias("node"), F.col("all.key").alias("keys"), F.col("all.quota").alias("quota"))
    for _ in range(levels):
        whole = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
        parts = F.transform("quota", lambda x, i: F.struct(x.alias("x"), (md5_number(F.concat_ws(" ", F.lit(str(seed)), F.col("node").cast("string"), i.cast("string")), 1, 13) / F.lit(float(1 << 52))).alias("u")))

        def deal(a: Column, s: Column) -> Column:
            got = hypergeometric(a["total"], s["x"], a["drawn"], s["u"])
            return F.struct((a["total"] - s["x"]).alias("total"), (a["drawn"] - got).alias("drawn"), F.array_append(a["out"], got).alias("out"))

        left = F.aggregate(parts, F.struct(whole.alias("total"), F.floor(whole / 2).alias("drawn"), F.array().cast("array<long>").alias("out")), deal, lambda a: a["out"])
        nodes = nodes.select("node", "keys", "quota", left.alias("left"))
        halves = F.array(F.col("left"), F.zip_with("quota", "left", lambda q, x: q - x))
        nodes = nodes.select("node", "keys", F.posexplode(halves).alias("side", "quota")).select((F.col("node") * 2 + F.col("side")).alias("node"), "keys", "quota")
    dealt = nodes.select("node", F.explode(F.arrays_zip("keys", "quota")).alias("x")).select("node", F.col("x.keys").alias("key"), F.col("x.quota").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("node"))
    return dealt.select("key", "node", upto.alias("upto")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "upto"))), lambda x: x["upto"]).alias("upto"))


def targets(blocks: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """A row for each source: size, target, and how it is met: ``full`` passes and ``rest`` words."""
    sources = blocks.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, (place - 1) % len(weights) + 1)).withColumn("most", F.col("source_size") * repeats)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    excess = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = excess / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.withColumn("level", level).withColumn("fits", F.col("most") / F.col("weight") >= F.col("level"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.coalesce("source", F.lit("")), F.col("level").alias("level")))).over(whole)
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce(first["level"], F.col("level")))
    goal = F.floor(target + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    return sources.select("key", "source_size", "n_blocks", target.alias("target"), full.alias("full"), (goal - full * F.col("source_size")).alias("rest"))


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    shards: int | None = None,
    words_per_shard: int = 1 << 26,
    blocks: int | None = None,
    seed: int = 20,
) -> DataFrame:
    """For each row its id, the columns ``keep``, and what the mix takes of it.

    ``size``, ``source_size``, ``target``, ``taken`` in words; ``draws``: structs of ``shard``,
    ``place`` (order within the shard) and ``words``, one for each time the mix takes it.
    ``shards`` is a power of two; by default 64, or as many as keep a shard's words at
    ``words_per_shard`` or fewer. ``blocks`` of a source follow the number of rows likewise.
    """
    if blocks is None:
        blocks = max(LEAST_BLOCKS, 1 << math.ceil(math.log2(max(1.0, docs.count() / BLOCK_ROWS))))
    key = F.coalesce(F.concat(F.lit("s"), col(source_col).cast("string")), F.lit("n"))
    name = F.concat_ws(" ", F.lit("doc"), F.coalesce(col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(col(text_col)), F.lit("")))
    others = [c for c in dict.fromkeys((id_col, *keep)) if c.lower() not in INTERNAL]
    rows = docs.select(
        F.struct(*[col(c) for c in others]).alias("row"),
        F.coalesce(F.regexp_count(col(text_col), F.lit(NON_SPACE_RUN)), F.lit(0)).cast("long").alias("size"),
        col(source_col).cast("string").alias("source"),
        key.alias("key"),
        (md5_number(name, 1, 8) % blocks).alias("block"),
        md5_number(name, 9, 15).alias("order"),
        name.alias("name"),
    )
    if not keep:
        rows = written(rows, "mix-rows")
    sums = written(rows.groupBy("key", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-blocks")
    sources = written(targets(sums, weights, share, repeats), "mix-sources")
    if shards is None:
        shards = max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1.0, (sources.agg(F.sum("target")).first()[0] or 0) / words_per_shard))))
    permuted = Window.partitionBy("key").orderBy(md5_number(F.concat("key", F.lit(" "), F.col("block").cast("string")), 1, 15), "block")
    planned = sums.select("key", "block", "words").join(sources, "key").withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    planned = planned.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    planned = written(planned.withColumn("copies", F.col("full") + (F.col("extra") > 0).cast("long")), "mix-plan")
    copies = planned.where("copies > 0").select("key", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy(md5_number(F.concat_ws(" ", F.lit(str(seed)), "key", F.col("block").cast("string"), F.col("copy").cast("string")), 1, 15), "block", "copy"))
    quotas = shard_quotas(planned.groupBy("key").agg(F.sum("copies").alias("quota")), shards, seed)
    placed = copies.withColumn("turn", turn).join(quotas, "key").select("key", "block", "copy", F.size(F.filter("upto", lambda x: x < F.col("turn"))).alias("shard"))
    placed = placed.groupBy("key", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    plan = written(planned.join(placed, ["key", "block"], "left").select("key", "block", "source_size", "target", "full", "extra", "shards"), "mix-draws")
    within = Window.partitionBy("key", "block").orderBy("order", "name", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("extra") - F.coalesce(F.col("ahead"), F.lit(0))))
    out = rows.withColumn("ahead", F.sum("size").over(within)).join(plan.hint("merge"), ["key", "block"]).withColumn("cut", cut)
    draws = F.filter(
        F.transform(
            F.coalesce("shards", F.array().cast("array<int>")),
            lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed), "name", i).alias("place"), F.when(i < F.col("full"), F.col("size")).otherwise(F.col("cut")).alias("words")),
        ),
        lambda d: d["words"] > 0,
    )
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    dealt = out.withColumn("draws", draws)
    return dealt.select(*[F.col("row")[c].alias(c) for c in others], "size", "source_size", "target", taken.alias("taken"), "draws")


def shard_rows(mix: DataFrame, *, text_col: str = "text") -> DataFrame:
    """A row for each draw, dealt to its shard's task and in the shard's order.

    ``text_col`` of a document that a shard takes in part is cut to its first ``words`` words,
    which a single space then parts. Columns ``shard``, ``place`` and ``words`` are replaced.
    """
    others = [c for c in mix.columns if c.lower() not in ("draws", "shard", "place", "words")]
    rows = mix.select(F.struct(*[col(c) for c in others]).alias("row"), F.explode("draws").alias("draw"))
    text, size = F.col("row").getField(text_col), F.col("row").getField("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(NON_SPACE_RUN), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") < size, cut).otherwise(text)
    rows = rows.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in others], F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"), F.col("draw.words").alias("words"))
    return rows.repartition("shard").sortWithinPartitions("shard", "place")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """``shards``: the shards of a document's draws, in the draws' order, comma-joined."""
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


OP10_SQL = r"""
WITH RECURSIVE n AS (
  SELECT greatest(4096, CAST(pow(2, ceil(log2(greatest(1.0::DOUBLE, count(*) / 4096.0::DOUBLE)))) AS BIGINT)) AS blocks FROM documents
), d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         'doc ' || coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(md5(text), '') AS name
  FROM documents
), r AS MATERIALIZED (
  SELECT *, CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % (SELECT blocks FROM n) AS block, CAST('0x' || substr(md5(name), 9, 15) AS BIGINT) AS o FROM d
), s AS (
  SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY k
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(most) OVER b AS DOUBLE), 0))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, most::DOUBLE / weight) AS level FROM l WHERE most::DOUBLE / weight >= level
), t AS (
  SELECT k, source_size, least(most::DOUBLE, weight * (SELECT level FROM f)) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS full_passes FROM t
), b AS (
  SELECT k, block, CAST(sum(size) AS BIGINT) AS words FROM r GROUP BY k, block
), p AS MATERIALIZED (
  SELECT b.k, b.block, source_size, target, full_passes,
         greatest(0, least(words, CAST(floor(target + 0.5) AS BIGINT) - full_passes * source_size
           - coalesce(sum(words) OVER (PARTITION BY b.k ORDER BY CAST('0x' || substr(md5(b.k || ' ' || b.block), 1, 15) AS BIGINT), b.block
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra
  FROM b JOIN g USING (k)
), c AS (
  SELECT k, block, unnest(range(1, full_passes + CAST(extra > 0 AS BIGINT) + 1)) AS copy FROM p
), turns AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST('0x' || substr(md5('20 ' || k || ' ' || block || ' ' || copy), 1, 15) AS BIGINT), block, copy) AS turn FROM c
), root AS (
  SELECT list(k ORDER BY k) AS ks, list(q ORDER BY k) AS qs FROM (SELECT k, count(*) AS q FROM turns GROUP BY k)
), depth AS (
  SELECT greatest(6, CAST(ceil(log2(greatest(1.0::DOUBLE, sum(target) / 67108864.0::DOUBLE))) AS BIGINT)) AS levels FROM t
), tree(node, qs, lefts, total, drawn) AS (
  SELECT 1::BIGINT, qs, []::BIGINT[], list_sum(qs)::BIGINT, list_sum(qs)::BIGINT // 2 FROM root
  UNION ALL
  SELECT CASE WHEN dealt THEN node * 2 + side ELSE node END, CASE WHEN dealt THEN half ELSE qs END,
         CASE WHEN dealt THEN []::BIGINT[] ELSE list_append(lefts, got) END,
         CASE WHEN dealt THEN list_sum(half)::BIGINT ELSE total - x END, CASE WHEN dealt THEN list_sum(half)::BIGINT // 2 ELSE drawn - got END
  FROM (SELECT *, CASE side WHEN 0 THEN lefts ELSE list_transform(range(1, len(qs) + 1), lambda i: qs[i] - lefts[i]) END AS half,
               CASE WHEN x = 0 OR drawn = 0 THEN 0 WHEN drawn = total THEN x ELSE least(high, lo + CAST(list_reduce(steps, lambda a, e:
                 [a[1] * (x - e[1]) * (drawn - e[1]) / ((e[1] + 1) * (total - x - drawn + e[1] + 1)), a[2] + a[1], a[3] + CAST(a[2] + a[1] <= bar AS INTEGER)::DOUBLE],
                 [1.0, 0.0, 0.0]::DOUBLE[])[3] AS BIGINT)) END AS got
        FROM (SELECT *, u * list_reduce(steps, lambda a, e:
                 [a[1] * (x - e[1]) * (drawn - e[1]) / ((e[1] + 1) * (total - x - drawn + e[1] + 1)), a[2] + a[1]], [1.0, 0.0]::DOUBLE[])[2] AS bar
              FROM (SELECT *, list_transform(range(lo, high + 1), lambda v: [v::DOUBLE]) AS steps
                    FROM (SELECT *, greatest(0, drawn + x - total, CAST(floor(mean - spread) AS BIGINT)) AS lo, least(x, drawn, CAST(ceil(mean + spread) AS BIGINT)) AS high
                          FROM (SELECT *, sqrt(mean * (1 - x::DOUBLE / greatest(total, 1)) * (total - drawn) / greatest(total - 1, 1)) * 12 + 12 AS spread
                                FROM (SELECT *, (drawn * x)::DOUBLE / greatest(total, 1) AS mean,
                                             CAST('0x' || substr(md5('20 ' || node || ' ' || len(lefts)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
                                      FROM (SELECT *, len(lefts) = len(qs) AS dealt, qs[len(lefts) + 1] AS x FROM tree WHERE node < (1::BIGINT << (SELECT levels FROM depth))))))))
        CROSS JOIN (VALUES (0), (1)) AS sides(side) WHERE dealt OR side = 0)
), leaves AS (
  SELECT node, unnest(root.ks) AS k, unnest(tree.qs) AS q FROM tree, root WHERE node >= (1::BIGINT << (SELECT levels FROM depth)) AND len(tree.lefts) = 0
), upto AS (
  SELECT k, list(upto ORDER BY node) AS ends FROM (SELECT k, node, sum(q) OVER (PARTITION BY k ORDER BY node)::BIGINT AS upto FROM leaves) GROUP BY k
), shards AS (
  SELECT k, block, list(CAST(len(list_filter(ends, lambda z: z < turn)) AS VARCHAR) ORDER BY copy) AS shards FROM turns JOIN upto USING (k) GROUP BY k, block
), a AS (
  SELECT r.*, coalesce(sum(size) OVER (PARTITION BY k, block ORDER BY o, name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r
), m AS (
  SELECT doc_id, size, source_size, target, full_passes, shards, CAST(greatest(0, least(size, extra - ahead)) AS BIGINT) AS cut
  FROM a JOIN p USING (k, block) LEFT JOIN shards USING (k, block)
)
SELECT doc_id, size, source_size, target, CAST(full_passes * size + cut AS BIGINT) AS taken,
       array_to_string(coalesce(shards, [])[1:CASE WHEN size = 0 THEN 0 ELSE full_passes + CAST(cut > 0 AS BIGINT) END], ',') AS shards
FROM m
"""
