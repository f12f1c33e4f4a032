"""Samples per prompt: pass@k, groups of rollouts, trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with sample: the place in its prompt, from 1."""
    return rows.withColumn("sample", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_hits(samples: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """keys, n and first_hit, the first sample that is right (null if none): all of pass@k comes from it."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.when(F.col(ok), F.col("sample"))).alias("first_hit"))


def curve(hits: DataFrame, keys: list[str], k_max: int) -> DataFrame:
    """keys, k, solved: prompts solved within k samples, for k = 1 .. k_max."""
    steps = hits.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"), "first_hit")
    return steps.groupBy(*keys, "k").agg(F.count("*").alias("prompts"), F.count_if(F.col("first_hit") <= F.col("k")).alias("solved"))


def all_trials(trials: DataFrame, keys: list[str], ok: str, needed: int) -> DataFrame:
    """keys, correct: exactly the needed number of trials, all of which match."""
    return trials.groupBy(*keys).agg(((F.count("*") == needed) & F.bool_and(F.coalesce(F.col(ok), F.lit(False)))).alias("correct"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are in both, in a only and in b only: one full outer join."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def advantages(rollouts: DataFrame, group: str, reward: Column, eps: float = 1e-6) -> DataFrame:
    """rollouts with adv = (r - mean) / (population deviation + eps) within the group; 0 where all rewards are equal."""
    r = rollouts.withColumn("reward", reward.cast("double"))
    g = r.groupBy(group).agg(F.avg("reward").alias("_m"), F.stddev_pop("reward").alias("_s"))
    return r.join(g, group).withColumn("adv", F.when(F.col("_s") > 0, (F.col("reward") - F.col("_m")) / (F.col("_s") + eps)).otherwise(0.0)).drop("_m", "_s")


def without_lowest(rollouts: DataFrame, group: str, reward: str, tie: str, n: int, parts: int = 64) -> DataFrame:
    """The rollouts left when each group's n lowest make room for its gold; (reward, tie) is unique in a group. The n lowest of each of
    `parts` parts of a group are found first, then those of the group, so a hot group isn't one task."""
    lowest = lambda rows, *by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(reward, tie))).filter(F.col("_r") <= n).drop("_r")
    few = lowest(rollouts.select(group, reward, tie, F.pmod(F.xxhash64(tie), F.lit(parts)).alias("_part")), group, "_part")
    return rollouts.join(lowest(few, group).select(group, reward, tie), [group, reward, tie], "left_anti")


def first_ok(attempts: DataFrame, keys: list[str], ok: str, order: str) -> DataFrame:
    """The retry loop on a table of attempts: the first that is right, else the last."""
    rest = [c for c in attempts.columns if c not in keys]
    at = F.struct(F.when(F.col(ok), F.lit(0)).otherwise(F.lit(1)), F.when(F.col(ok), F.col(order)).otherwise(-F.col(order)))
    return attempts.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")
