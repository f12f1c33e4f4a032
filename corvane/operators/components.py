"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.store import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) -> (id, component) of every node with an edge; component is the least id reachable.

    Alternates large-star and small-star steps, each one shuffle with partial aggregation, until nothing changes; the rounds
    grow as the logarithm of the longest path; more than max_rounds are an error. The edges stay in written tables; only counts reach the driver."""
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("m", "v").filter("m <> v").select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        now = written(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components haven't settled in {max_rounds} rounds")
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("id"), F.col("u").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
