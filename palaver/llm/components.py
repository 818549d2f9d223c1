"""Connected components by contraction: every round each vertex joins the neighbour with the least random number.

Round by round the graph of representatives shrinks by a constant factor in expectation, whatever its shape. Edges and
maps are tables in the shared folder, so nothing is collected and a lost executor costs one round at most. A crowded
vertex is met only by pre-aggregated minima and by joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import stage


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(v, component) for every vertex of the edges (a long, b long); component is its class's smallest vertex.

    Repeated edges and loops are allowed, edges with a null end are ignored, no edges give no rows.
    """
    left = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stage(left.distinct(), label)
    maps: list[DataFrame] = []
    while left.count():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        ways = left.select(F.col("a").alias("v"), order("b").alias("to")).union(
            left.select(F.col("b").alias("v"), order("a").alias("to"))
        )
        best = ways.groupBy("v").agg(F.min("to").alias("to"))
        step = stage(best.select("v", F.least("to", order("v"))["id"].alias("rep")), label)
        maps.append(step)
        ends = left.join(step.withColumnsRenamed({"v": "a", "rep": "ra"}), "a")
        ends = ends.join(step.withColumnsRenamed({"v": "b", "rep": "rb"}), "b").where(F.col("ra") != F.col("rb"))
        left = stage(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), label)
    if not maps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("v").alias("rep"), F.col("rep").alias("root"))
        joined = maps.pop().join(later, "rep", "left")
        whole = joined.select("v", F.coalesce("root", "rep").alias("rep"))
    whole = stage(whole, label)
    least = whole.groupBy("rep").agg(F.min("v").alias("component"))
    return whole.join(least, "rep").select("v", "component")
