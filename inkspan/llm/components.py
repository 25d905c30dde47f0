"""Connected components by alternating large-star and small-star steps, as joins and aggregates over edges.

Defined results: edges with a null end and loops link nothing; repeated edges count once, in either direction; nodes
without an edge aren't in the result; no edges give an empty result; other columns than u and v are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them: the larger ones (large), or the smaller ones and itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any order, repeated or with loops -> (node, component), component being the least node reachable.

    Every round is written to the shared folder. The largest key of a join is a node's degree, which AQE can split.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both, True), "edges")
        now = cut(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
