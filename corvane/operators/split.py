"""Shuffles, quotas and folds that don't depend on partitioning: order comes from a hash of (seed, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, key: Column) -> Column:
    """A seeded order. It isn't a generator's shuffle; it is the same on every engine and at every parallelism."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(rows: DataFrame, key: str, seed: int, within: str | None = None) -> DataFrame:
    """rows with _r: the place, from 1, in the seeded order, in each group of within. The order's digests fall into 4096 ranges; a place is
    the count of the ranges before and the place in its own, so neither a group nor the whole is one task. Rows whose group is null
    have no place and fall out."""
    by = [within] if within else []
    keyed = rows.withColumn("_o", order_key(seed, F.col(key))).withColumn("_b", F.substring("_o", 1, 3))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a group
    base = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_o", key))
    return keyed.withColumn("_i", inner).join(base, [*by, "_b"]).withColumn("_r", F.col("_base") + F.col("_i")).select(*rows.columns, "_r")


def stratified(rows: DataFrame, key: str, stratum: str, quotas: dict[str, tuple[int, int]], seed: int) -> DataFrame:
    """rows with split: in each stratum the first quotas[stratum][0] rows are dev, the next [1] train; all others fall out."""
    out = F.lit(None).cast("string")
    for name, (dev, train) in quotas.items():
        here = F.col(stratum) == name
        out = F.when(here & (F.col("_r") <= dev), "dev").when(here & (F.col("_r") <= dev + train), "train").otherwise(out)
    return ranked(rows, key, seed, stratum).withColumn("split", out).filter("split is not null").drop("_r")


def dev_quotas(counts: dict[str, int], first: str, n_dev: int) -> dict[str, int]:
    """The dev rows of each of two strata in proportion, the remainder to the second."""
    (second,) = [s for s in counts if s != first]
    share = n_dev * counts[first] // (counts[first] + counts[second])
    return {first: share, second: n_dev - share}


def topped_up(first: DataFrame, rest: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All of first, then rest in seeded order until there are n rows. Both have the same columns."""
    both = first.withColumn("_p", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1)))
    return both.withColumn("_o", order_key(seed, F.col(key))).orderBy("_p", "_o", key).limit(n).drop("_p", "_o")


def folds(rows: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """rows with fold in 0 .. k - 1; a group is never split, and folds differ by at most one group. The group table is ranked by
    a hash, its rows are joined back."""
    places = ranked(rows.select(group).distinct(), group, seed)
    return rows.join(places.select(group, ((F.col("_r") - 1) % k).cast("int").alias("fold")), group)
