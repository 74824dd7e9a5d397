"""Connected components of an undirected edge table, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Steps, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Each node that has an edge, with the smallest node it can reach.

    edges: columns u and v (any orderable type, one type); direction, loops,
    repeats and nulls do not matter, rows with a null are ignored. Returns
    node, component.

    Alternating star contraction: each round points every larger neighbour of
    a node at the node's smallest neighbour, then does the same for the smaller
    ones. The number of rounds grows with the logarithm of a component's size.
    Minima are aggregated before the shuffle and joined back by an equi-join
    whose skewed partitions Spark may split, so a hub's neighbours are never
    brought together in one task. Every round is written to the shared folder.
    """
    with Steps(edges.sparkSession, "components") as steps:
        return written(_settled(edges, steps, max_rounds), "components")


def _settled(edges: DataFrame, steps: Steps, max_rounds: int) -> DataFrame:
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = steps.written(edges.distinct(), "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        after = steps.written(small.select("e.*").where("u <> v").distinct(), "edges")
        steps.dropped(edges)
        edges, was, before = after, before, _state(after)
        if before == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
