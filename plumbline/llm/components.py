"""Connected components of a graph of ids by alternating large-star and small-star steps.

A node of very high degree is never gathered: a step needs only the smallest neighbour of each node,
which is a partial aggregate, and a join that adaptive execution splits where one node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large: larger neighbours of u point to its minimum; small: smaller ones do."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = (around.where("v > u") if large else edges).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has two columns of ids, in either order; self links, repeats and nulls are ignored.
    """
    a, b = edges.columns
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = keep(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
    before = e.agg(*mark).first()
    for _ in range(most_rounds):
        if not before["n"]:
            break
        e = keep(_star(_star(e, True), False), "star")
        after = e.agg(*mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
