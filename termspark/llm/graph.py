"""Connected components of a link table, as DataFrame joins."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links(a, b) -> (node, component), component = smallest node reachable.

    A distributed union-find: every node holds a parent; each round hooks a
    node and its parent below the smallest parent among its neighbours, then
    halves the paths.  Rounds grow with the logarithm of the longest chain.
    Whether anything changed is all that reaches the driver.  Self links and repeated
    links are harmless; null ends are ignored; no links give no rows.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    # a checkpoint keeps its partitioning: edges lie by v and parents by n, so the joins of a round move nothing twice
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = materialize(both.repartition(parts, "v"))
    parents = materialize(edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
                          .select("n", F.least("n", "m").alias("p")))

    while True:
        near = (edges.join(parents.select(F.col("n").alias("v"), F.col("p").alias("pv")), "v")
                .groupBy(F.col("u").alias("n")).agg(F.min("pv").alias("m")))
        hook = parents.join(near, "n").select("n", "p", F.least("p", "m").alias("q"))
        low = (hook.select("n", "q", "p").union(hook.select(F.col("p").alias("n"), "q", F.lit(None).cast("long").alias("p")))
               .groupBy("n").agg(F.min("q").alias("p"), F.max("p").alias("was")))
        # one table a round: the union's aggregation is an exchange that both sides of the join read
        parents = materialize(
            low.join(low.select(F.col("n").alias("p"), F.col("p").alias("g")), "p", "left")
            .select("n", F.coalesce("g", "p").alias("p"), "was").repartition(parts, "n"))
        if not parents.where("p <> was").take(1):
            return parents.select(F.col("n").alias("node"), F.col("p").alias("component"))
        parents = parents.select("n", "p")


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (a, b) connect, at most one a node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, low = inv[:len(a)], inv[len(a):], np.arange(len(nodes))
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = new[new]
        if (new == low).all():
            return [(int(nodes[k]), int(nodes[v])) for k, v in enumerate(low) if k != v]
        low = new
