"""Connected components by alternating large-star and small-star, on DataFrames.

Each round is two grouped minima and two joins. The minima are a broadcast where the edges are counted and few; else
they are written first, so that Spark can split the join where a node has very many neighbours. Every round is written
to the shared folder, so lineage stays short and a lost executor costs its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch


#: Edges up to which the least neighbours, at most two rows an edge of 16 bytes, are broadcast.
FEW_EDGES = 500_000


def _star(edges: DataFrame, larger: bool, hold) -> DataFrame:
    """edges: (u, v) with u > v. Connects neighbours to the least of each neighbourhood; ``hold`` readies the minima for their join.

    Large star: of every node, its larger neighbours. Small star: its smaller ones, and the node itself.
    """
    if larger:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = hold(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = hold(edges.groupBy("u").agg(F.min("v").alias("m")))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component: the least node reachable.

    edges: (a, b) longs. Loops, repeated edges and nulls count for nothing.
    """
    now = scratch.put(f"{tag}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, now.count()
    for i in range(1, most_rounds + 1):
        if n <= FEW_EDGES:
            now = scratch.put(f"{tag}-{i}", _star(_star(now, True, F.broadcast), False, F.broadcast))
        else:
            large = scratch.put(f"{tag}-{i}-large", _star(now, True, lambda m, at=f"{tag}-{i}-m": scratch.put(at, m)))
            now = scratch.put(f"{tag}-{i}", _star(large, False, lambda m, at=f"{tag}-{i}-n": scratch.put(at, m)))
            for held in ("-large", "-m", "-n"):
                scratch.drop(f"{tag}-{i}{held}")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{tag}-{i - 1}")
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError("the stars didn't settle")
    members = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return members.select(F.col("u").alias("node"), "component").union(roots)
