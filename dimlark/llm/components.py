"""Connected components of a graph of links, by least neighbour labels and pointer jumping.

Each round is two joins and a grouped minimum over tables written to the shared folder, so a
lost executor costs a task and not the rounds before. Both sides of a join come straight from
such a table, which lets Spark split the partition of a hub. The number of rounds grows with
the logarithm of the longest path in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, label)`` for each node in a link; label: the least node reachable.

    Self-links and repeated links do no harm; without links the result is empty.
    """
    links = links.where(F.col("a") != F.col("b"))
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = written(both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")), "near")
        hooked = written(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "hooked")
        roots = hooked.select(F.col("node").alias("root"), F.col("label").alias("top"))
        jumped = written(hooked.join(roots, hooked["label"] == roots["root"]).select("node", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("moved")), "jumped")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
