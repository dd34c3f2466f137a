"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being the smallest node reachable.

    Alternates the two star operations of Kiveris et al. (2014): each round links neighbours to the smallest node
    near them, so that long paths shrink by half a round. Nodes with very many neighbours are summed up before they are shuffled.
    Each round is written to the shared folder. Edges from a node to itself keep that node in the result. Rounds grow with the logarithm of the nodes;
    should ``max_rounds`` not be enough, that is an error, as a result would lack links.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node go to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(edges.filter("a = b")).distinct()
        # Small star: a node and its neighbours below it go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = written(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
