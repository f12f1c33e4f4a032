"""Differential scoring: golds run twice, candidates run on the same inputs, and what is made of the trials.

Golds come as (keys, exclusion, public signature), runs as (keys, trial, run, out), candidates with their verdicts, trials as
(keys, trial, lower_ok, exec_ok, match). Running programs is outside; its outputs enter as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.stats import count_interval


def gold_gate(golds: DataFrame, runs: DataFrame, keys: list[str], trials: int) -> DataFrame:
    """golds (keys, reason) and runs (keys, trial, run, out) -> keys, gate, reason: 'excluded' with a reason; 'pass' if every trial was
    run twice with the same output; else 'fail'. A null output is a run that failed."""
    same = runs.groupBy(*keys, "trial").agg((F.count("out") == 2).alias("ran"), (F.min("out") == F.max("out")).alias("same"))
    steady = same.groupBy(*keys).agg(F.count_if(F.col("ran") & F.col("same")).alias("n"))
    gate = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("n") == trials, "pass").otherwise("fail")
    return golds.join(steady, keys, "left").select(*keys, gate.alias("gate"), "reason")


def outcomes(trials: DataFrame, keys: list[str], needed: int) -> DataFrame:
    """keys, lower_ok, exec_ok, functional_match: over exactly the needed number of trials; fewer or more match nothing."""
    every = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(False)))
    return trials.groupBy(*keys).agg(every("lower_ok").alias("lower_ok"), every("exec_ok").alias("exec_ok"), ((F.count("*") == needed) & every("match")).alias("functional_match"))


def status(found: Column, verified: Column, match: Column) -> Column:
    """What became of a gate-passed gold's candidate: no row, not verified, another signature, or scored."""
    return F.when(~found, "no_candidate_row").when(~F.coalesce(verified, F.lit(False)), "not_verified").when(match == "mismatch", "signature_mismatch").otherwise("scored")


def aggregate(gates: DataFrame, prompts: DataFrame, keys: list[str], gate_keys: list[str], resamples: int = 10_000) -> DataFrame:
    """gates (gate_keys, gate) and prompts (keys, status, dim_relaxed, functional_match), one row for each gate-passed gold -> a row per
    keys: golds by gate, scored and relaxed candidates, and the match rate among scored and among gate-passed ones with intervals.
    gate_keys are those of keys that golds have."""
    gold = gates.groupBy(*gate_keys).agg(F.count("*").alias("n_gold"), *[F.count_if(F.col("gate") == g).alias("n_" + g) for g in ("excluded", "fail", "pass")])
    scored = F.col("status") == "scored"
    match = scored & F.coalesce("functional_match", F.lit(False))
    got = prompts.groupBy(*keys).agg(F.count("*").alias("n_prompts"), F.count_if(scored).alias("n_scored"), F.count_if(scored & F.col("dim_relaxed")).alias("n_dim_relaxed"), F.count_if(match).alias("n_match"))
    for of, n in (("scored", "n_scored"), ("gate", "n_prompts")):
        one = count_interval(got.withColumns({"n": F.col(n), "s": F.col("n_match")}), resamples)
        rate = F.when(F.col("n") > 0, F.col("point"))
        got = one.withColumns({f"rate_{of}": rate, f"low_{of}": F.col("ci_low"), f"high_{of}": F.col("ci_high")}).drop("n", "s", "point", "ci_low", "ci_high")
    return got.join(gold, gate_keys)


def rollup(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows (keys, by, verify_valid, lower_ok, exec_ok, functional_match) -> rates per keys and by, and per keys over all (is_total)."""
    each = rows.withColumn("_by", F.explode(F.array(F.struct(F.lit(0).alias("is_total"), F.col(by).alias("v")), F.struct(F.lit(1).alias("is_total"), F.lit(None).cast("string").alias("v")))))
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    out = each.groupBy(*keys, F.col("_by.v").alias(by), F.col("_by.is_total").alias("is_total"))
    return out.agg(F.count("*").alias("n"), *[rate(c).alias(n) for c, n in (("verify_valid", "verify_rate"), ("lower_ok", "lower_rate"), ("exec_ok", "exec_rate"), ("functional_match", "match_rate"))])


def histogram(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    return rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
