"""Merkle manifest of a dataset: a hash tree for each source, and one over the sources' roots.

A document's leaf is the SHA-256 of its fields, each with its length before it. A source's leaves,
by document id, stand in aligned blocks of ``FAN ** DEPTH``. A block keeps each of its levels as
one string of hex digests: fixed-width substrings of a level are the runs whose digests make the
next one, and what flanks a digest within its run is the document's sibling segment there. The
digests of whole blocks are the leaves of the next tier of blocks, until one remains for each
source; the sources' digests go through the same tiers once more, under one key.

Proofs come down the tiers: a block's segments above itself are joined to it once, and its leaves
put theirs in front. No text is shuffled, only ids and digests, and a source of any size is
spread by ranges of its ids (``places``).

Cases: null fields hash as ``-``. Null ids stand first and are never tampered with. Rows alike in
source and id stand by their leaf; rows alike in all fields are leaves of their own. A lone leaf is
its source's root, a lone source's root the manifest's. An empty table has no rows and no root.
Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table, written
from .places import placed

#: Digests hashed together, hex digits of one, and levels that a block spans.
FAN, WIDTH, DEPTH = 3, 64, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, each as its UTF-8 byte count, a colon and its value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return digest(F.concat(*told))


def height(of: Column) -> Column:
    """Levels above ``of`` leaves."""
    return F.size(F.filter(F.lit([FAN**k for k in range(39)]), lambda p: p < of))


def runs(level: Column) -> Column:
    """A level's digests in runs of ``FAN``, one string each."""
    many = F.ceil(F.length(level) / (FAN * WIDTH)).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda r: F.substring(level, r * FAN * WIDTH + 1, F.lit(FAN * WIDTH)))


@dataclass(frozen=True)
class Tree:
    """``tiers[t]``: a row for each ``key`` and ``block`` with ``items`` by place, the tree's ``height`` and the block's ``levels``.

    ``roots``: ``key``, ``root`` and ``height``.
    """

    tiers: list[DataFrame]
    roots: DataFrame


def tree(nodes: DataFrame, tag: str) -> Tree:
    """Hash trees over ``nodes(key, place, of, node, item)``; ``item`` is kept beside its digest in the first tier."""
    nodes = nodes.select("key", "place", height(F.col("of")).alias("height"), "node", "item")
    tiers, roots = [], None
    for t in count():
        block = F.floor(F.col("place") / FAN**DEPTH).alias("block")
        rows = nodes.groupBy("key", "height", block).agg(F.sort_array(F.collect_list(F.struct("place", "node", "item"))).alias("held"))
        rows = rows.select("key", "height", "block", F.transform("held", lambda x: x["item"]).alias("items"), F.array(F.array_join(F.transform("held", lambda x: x["node"]), "")).alias("levels"))
        for up in range(DEPTH):
            last = F.element_at("levels", -1)
            above = F.array_append("levels", F.array_join(F.transform(runs(last), digest), ""))
            rows = rows.withColumn("levels", F.when(F.col("height") > t * DEPTH + up, above).otherwise(F.col("levels")))
        tiers.append(written(rows, f"{tag}-tier"))
        tops = tiers[-1].select("key", "height", F.col("block").alias("place"), F.element_at("levels", -1).alias("node"))
        done = tops.where(F.col("height") <= (t + 1) * DEPTH).select("key", F.col("node").alias("root"), "height")
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where(F.col("height") > (t + 1) * DEPTH).withColumn("item", F.lit(None).cast("string"))
        if nodes.isEmpty():
            return Tree(tiers, written(roots, f"{tag}-roots"))


def segments(place: Column, levels: Column, above: Column) -> Column:
    """What flanks the digest at ``place`` of a block on each level, then ``above``; ``levels``: the runs of each level but the last."""

    def flanks(level: Column, up: Column) -> Column:
        at = F.floor(place / F.element_at(F.lit([FAN**k for k in range(DEPTH)]), up + 1))
        own = F.element_at(level, (F.floor(at / FAN) + 1).cast("int"))
        nth = (at % FAN).cast("int")
        return F.struct(F.substring(own, F.lit(1), nth * WIDTH).alias("left"), F.substring(own, (nth + 1) * WIDTH + 1, F.lit(FAN * WIDTH)).alias("right"))

    return F.concat(F.transform(levels, flanks), above)


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """``above(key, carried, path)`` -> ``(key, item, node, carried, path)`` for each leaf; ``path``: segments from the leaf up.

    ``carried`` is any value that goes with a key.
    """
    ends = above.join(tree.roots, "key").select("key", "height", F.lit(0).cast("long").alias("block"), "carried", F.col("path").alias("above"))
    children, nth = None, lambda i: ((i % FAN) * WIDTH + 1).cast("int")
    for t in range(len(tree.tiers) - 1, -1, -1):
        ups = ends.where((F.col("height") <= (t + 1) * DEPTH) & (F.col("height") > (t * DEPTH if t else -1))).drop("height")
        ups = ups.unionByName(children) if children else ups
        rows = tree.tiers[t].join(ups, ["key", "block"])
        rows = rows.withColumn("first", runs(F.element_at("levels", 1))).withColumn("runs", F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), runs))
        node = lambda i: F.substring(F.element_at("first", (F.floor(i / FAN) + 1).cast("int")), nth(i), F.lit(WIDTH))
        held = F.transform("items", lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("item"), node(i).alias("node"), segments(i, F.col("runs"), F.col("above")).alias("path")))
        rows = rows.select("key", "block", "carried", F.explode_outer(held).alias("x"))
        if not t:
            break
        children = written(rows.select("key", (F.col("block") * FAN**DEPTH + F.col("x.at")).alias("block"), "carried", F.col("x.path").alias("above")), "merkle-paths")
    return rows.select("key", "x.item", "x.node", "carried", "x.path")


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` and its sibling segments make."""
    return F.aggregate(path, node, lambda a, s: digest(F.concat(s["left"], a, s["right"])))


@dataclass(frozen=True)
class Manifest:
    """``sources``: the tree over each source's leaves; ``whole``: that over the sources' roots, under one key."""

    sources: Tree
    whole: Tree


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", item: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``item``: a column kept beside each leaf, by default the id."""
    key = F.coalesce(F.concat(F.lit("s"), col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(key.alias("key"), col(id_col).alias("id"), leaf([col(c) for c in fields]).alias("node"), (col(id_col) if item is None else item).alias("item"))
    rows = placed(written(rows, "merkle-leaves"), "key", ("id", "node"), tag="merkle-order")
    sources = tree(rows, "merkle")
    # "n" stands before every "s": the source without a name is first, the others go by their bytes
    subroots = sources.roots.select(F.lit("all").alias("key"), F.col("key").alias("id"), F.col("root").alias("node"), F.struct(F.col("key").alias("source"), F.col("root").alias("subroot")).alias("item"))
    return Manifest(sources, tree(placed(subroots, "key", ("id",), tag="merkle-sources"), "merkle-whole"))


def proofs(made: Manifest) -> DataFrame:
    """``(item, leaf, subroot, root, path)`` for each document; ``path``: what flanks it on each level, from the leaf to the root."""
    none = F.array().cast(PATH)
    tops = made.whole.roots.select("key", F.col("root").alias("carried"), none.alias("path"))
    subs = paths(made.whole, tops).select(F.col("item.source").alias("key"), F.struct("item.subroot", F.col("carried").alias("root")).alias("carried"), "path")
    return paths(made.sources, written(subs, "merkle-subroots")).select("item", F.col("node").alias("leaf"), "carried.subroot", "carried.root", "path")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    tampered = F.when(cut, leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]))
    proved = proofs(manifest(docs, item=F.struct("doc_id", tampered.alias("tampered"))))
    shown = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = proved.select("item.doc_id", "leaf", "subroot", "root", shown.alias("proof_sha256"), folded(F.coalesce("item.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The reflected CRC-32 of a decimal's digits: its generator and start are those of zip files.
CRC32 = """(xor(4294967295, list_reduce(flatten([[4294967295]] || list_transform(range(1, length(CAST({id} AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(substr(CAST({id} AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)))"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(text if f == "text" else f) for f in FIELDS) + ")"

OP12_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, {_LEAF("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {CRC32.format(id="doc_id")} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS shown
  FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l
), t AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda r: sha256(array_to_string(nodes[3 * r + 1 : 3 * r + 3], '')))
  FROM t WHERE len(nodes) > 1
), s AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1
), w AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda r: sha256(array_to_string(nodes[3 * r + 1 : 3 * r + 3], '')))
  FROM w WHERE len(nodes) > 1
), up AS (
  SELECT source, level, nodes, max(level) OVER (PARTITION BY source) AS height FROM t
), f AS (
  SELECT p.doc_id, p.source, p.place, p.place AS at, 0 AS level, p.leaf, p.shown AS cur, '' AS proof, false AS whole FROM p
  UNION ALL
  SELECT f.doc_id, f.source, f.place, CASE WHEN u.level = u.height THEN s.place ELSE f.at // 3 END,
         CASE WHEN u.level = u.height THEN 0 ELSE f.level + 1 END, f.leaf,
         CASE WHEN u.level = u.height THEN f.cur
              ELSE sha256(array_to_string(u.nodes[f.at - f.at % 3 + 1 : f.at], '') || f.cur || array_to_string(u.nodes[f.at + 2 : f.at - f.at % 3 + 3], '')) END,
         CASE WHEN u.level = u.height THEN f.proof
              ELSE f.proof || array_to_string(u.nodes[f.at - f.at % 3 + 1 : f.at], '') || array_to_string(u.nodes[f.at + 2 : f.at - f.at % 3 + 3], '') END,
         u.level = u.height
  FROM f JOIN up u ON NOT f.whole AND u.source IS NOT DISTINCT FROM f.source AND u.level = f.level JOIN s ON s.source IS NOT DISTINCT FROM f.source
), g AS (
  SELECT * FROM f WHERE whole
  UNION ALL
  SELECT g.doc_id, g.source, g.place, g.at // 3, g.level + 1, g.leaf,
         sha256(array_to_string(w.nodes[g.at - g.at % 3 + 1 : g.at], '') || g.cur || array_to_string(w.nodes[g.at + 2 : g.at - g.at % 3 + 3], '')),
         g.proof || array_to_string(w.nodes[g.at - g.at % 3 + 1 : g.at], '') || array_to_string(w.nodes[g.at + 2 : g.at - g.at % 3 + 3], ''), true
  FROM g JOIN w ON w.level = g.level WHERE len(w.nodes) > 1
)
SELECT g.doc_id, g.leaf, s.subroot, r.nodes[1] AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = r.nodes[1] AS verified
FROM g JOIN (SELECT * FROM w WHERE len(nodes) = 1) r ON g.level = r.level JOIN s ON s.source IS NOT DISTINCT FROM g.source
"""
