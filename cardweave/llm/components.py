"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: each larger neighbour of a node goes to the node's minimum; small: each smaller one does.

    The minimum is aggregated before the shuffle and joined back, so a node with
    very many neighbours is a skewed join, not a group in one task.
    """
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = pairs.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): component is the least node that can be reached.

    ``edges`` has u and v. Nodes without an edge to another are not in the result.
    The number of rounds grows with the logarithm of the nodes; each is written
    to the shared folder, and the one before is deleted.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(rounds):
        new = cut(_star(_star(now, True), False))
        # Stable once every node hangs on one root that itself hangs on none.
        mark = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        drop_cut(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
