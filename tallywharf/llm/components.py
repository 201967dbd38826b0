"""Connected components: up to `FEW` links in one task on an executor, more by alternating large-star and small-star steps, as joins and minima only.

No star step gathers a node's neighbours in a list, so a hub with a third of all links is dealt with by partial minima and by joins
that deal its links to several tasks (common.spread_join). Lineage is cut after every turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, hot_keys, looked_up, ship, spread_join

#: Links up to which one task finds the components; a hundred bytes each, about.
FEW = 1_000_000


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    few = looked_up(hot_keys(least, ["a"]))
    return spread_join(both.filter(F.col("b") > F.col("a")), least.drop("n"), ["a"], ["b"], few).select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(edges, least.drop("n"), ["a"], ["b"], looked_up(hot_keys(least, ["a"]))).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def is_settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one edge down, to a node that has none."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def merged(links: DataFrame) -> DataFrame:
    """The components of a few links: a union-find over numbered nodes, in one task."""
    import pyarrow as pa

    ship(links.sparkSession)

    def run(batches):
        import numpy as np

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))
        for x, y in zip(number[: len(a)].tolist(), number[len(a) :].tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
        for i in range(len(up)):  # parents are smaller, so they are done
            up[i] = up[up[i]]
        root = nodes[np.array(up, np.int64)]
        on = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(root[on])], names=["node", "comp"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, comp long")


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """links: a, b; `most`: a known bound of their number. Rows (node, comp) with the smallest node of each component, for all nodes but those smallest."""
    if (links.count() if most is None else most) <= FEW:
        return compact(merged(links), "components", FEW)
    return by_stars(links)


def by_stars(links: DataFrame) -> DataFrame:
    """Every turn at least keeps all components and lowers some node's parent, so the turns end; their number grows as the logarithm of the nodes, squared at worst."""
    edges = compact(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not is_settled(edges):
        edges = compact(small_star(large_star(edges).filter("a != b").distinct()).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
