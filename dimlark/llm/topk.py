"""Exact top-k by no-random-access aggregation over sorted lists.

Vectors become integers, floor(scale * x). For a query, each dimension is a list of the rows
sorted by their share of the score, best first. The lists are read from the top in step, a
stretch at a time, once for a batch of queries. A row's lower bound is what was read of it plus
the least share of each dimension still unread; its upper bound takes the share last read there
instead. Rows whose upper bound lies below the k-th best lower bound cannot qualify and are
left. When few are left, or the lists end, what is still unread of those rows completes their
scores, in whole numbers, and the best k are kept. Vectors of many independent dimensions have no
bound that holds before most of the lists are read, so the first stretch is a long one.

Queries are a stated set, taken in blocks against blocks of rows: each pair of blocks is one
task's group of bounded size, and only its best k of each query go on. Blocks are chosen by a
hash of the row's number, so rows that repeat an id, or a whole vector, spread like others.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows
with a null id. Only vectors of equal length are compared. A query skips rows of its own id.
Repeated ids count as rows of their own, as queries too, and ties in score go to the smaller id. Scores that
64 bits cannot hold are cut to the largest or smallest that they can.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, table, written

#: Depths, as shares of the lists, down to which they are read before bounds are compared.
DEPTHS = (0.6, 0.8, 0.88, 0.94, 1.0)
#: With so few rows left, their scores are computed in full.
FEW = 64
#: Queries that share one reading of a block's lists.
AT_ONCE = 256
LONG = np.iinfo(np.int64)


def whole_vector(vector: Column, scale: int) -> tuple[Column, Column]:
    """Whether the vector takes part, and its integer components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; beyond 64 bits they are cut."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if float(np.abs(rows.astype(float)).max()) * float(np.abs(query.astype(float)).max()) * len(query) < 2.0**62:
        return rows @ query
    return np.array([min(LONG.max, max(LONG.min, sum(int(a) * int(b) for a, b in zip(r, query, strict=True)))) for r in rows], np.int64)


class SortedLists:
    """The lists of one block of rows: each dimension from its largest value down and from its smallest up.

    A query with a positive weight for a dimension reads the first list, with a negative weight
    the second. The lists are read once for a batch of queries; what was read of a row is kept
    in ``read``, and ``unread`` marks the rest. Bounds come from these two alone.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        n, dims = vectors.shape
        up = np.argsort(vectors, axis=0, kind="stable").T
        self.order = np.concatenate([up[:, ::-1], up])
        both = np.concatenate([vectors.T, vectors.T])
        self.real = np.float32 if float(np.abs(both.astype(float)).max()) ** 2 * dims < 1e30 else np.float64
        self.values = np.take_along_axis(both, self.order, axis=1).astype(self.real)
        self.size = np.abs(self.values).max(axis=1)

    def top(self, query_ids: np.ndarray, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(query's place among the queries, row id, score) of the block's best k rows of each query."""
        n, lists = len(self.ids), len(self.order)
        weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(self.real)
        read, unread = np.zeros((lists, n), self.real), np.ones((lists, n), self.real)
        slack = 1e3 * np.finfo(self.real).eps * (np.abs(weights) @ self.size)
        least = weights * self.values[:, -1]
        waiting, out, begin = np.arange(len(queries)), [], 0
        own = {int(q): np.flatnonzero(self.ids == q) for q in query_ids}
        for depth in DEPTHS:
            end = max(begin + 1, int(depth * n)) if n else 0
            rows = self.order[:, begin:end]
            np.put_along_axis(read, rows, self.values[:, begin:end], axis=1)
            np.put_along_axis(unread, rows, 0, axis=1)
            begin = min(end, n)
            w = weights[waiting]
            seen = w @ read
            lower, upper = seen + least[waiting] @ unread, seen + (w * self.values[:, begin - 1]) @ unread
            for i, q in enumerate(waiting):
                lower[i, own[int(query_ids[q])]] = upper[i, own[int(query_ids[q])]] = -np.inf
            bar = np.partition(lower, -self.k, axis=1)[:, -self.k] if n > self.k else np.full(len(waiting), -np.inf)
            left = upper >= np.maximum(bar - 2 * slack[waiting], np.finfo(self.real).min)[:, None]
            done = (left.sum(axis=1) <= FEW) | (begin == n)
            for i in np.flatnonzero(done):
                out += self.resolved(int(waiting[i]), queries[waiting[i]], np.flatnonzero(left[i]))
            waiting = waiting[~done]
            if not len(waiting) or begin == n:
                break
        return out

    def resolved(self, place: int, query: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """The best k of the rows by their full scores."""
        scores, ids = exact_scores(self.vectors[rows], query), self.ids[rows]
        best = sorted(zip((-scores.astype(object)).tolist(), ids.tolist(), strict=True))[: self.k]
        return [(place, i, -s) for s, i in best]


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, block_rows: int = 16_384, block_queries: int = 1_024) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row the k best other rows."""
    fits, components = whole_vector(col(vector_col), scale)
    rows = written(
        vectors.where(fits & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), components.alias("v"), F.size(col(vector_col)).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")),
        "vectors",
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_queries))
    place = F.xxhash64("row")
    to_all = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = (
        rows.select("row", "id", "v", "dim", F.lit(False).alias("q"), F.pmod(place, F.lit(row_blocks)).cast("int").alias("rb"), to_all(query_blocks).alias("qb")),
        rows.where("q").select("row", "id", "v", "dim", "q", to_all(row_blocks).alias("rb"), F.pmod(place, F.lit(query_blocks)).cast("int").alias("qb")),
    )

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf["q"]]
        out = []
        if len(own):
            lists, asked = SortedLists(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), k), pdf[pdf["q"]]
            for at in range(0, len(asked), AT_ONCE):
                part = asked.iloc[at : at + AT_ONCE]
                rows, ids = part["row"].to_numpy(), part["id"].to_numpy()
                out += [(rows[at], ids[at], i, s) for at, i, s in lists.top(ids, np.stack(part["v"].to_numpy()))]
        return pd.DataFrame(out, columns=["row", "query_id", "id", "score"])

    found = sides[0].union(sides[1]).where("dim > 0").groupBy("dim", "rb", "qb").applyInPandas(best, "row long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    return found.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def op8_topk(spark, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
