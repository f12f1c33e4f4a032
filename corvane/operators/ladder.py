"""Evaluation logs: cells, rates, paired rungs, residuals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import error_category, shape_error, unknown_ops
from corvane.operators.stats import count_interval

CELL = ["model", "pool", "constraint_stack", "prompt_id"]
#: The rungs, each stack and the one below it.
RUNGS = (("c1", "none"), ("c1_c2", "c1"), ("c1_c2_c3", "c1_c2"), ("c1_c2_c3", "none"))
#: The stack whose arm each layer's flag is compared with.
STACK = {"v1": "c1", "v1_vocab": "c1", "v1_struct": "c1", "v2": "c1_c2", "v3": "c1_c2_c3", "v4": "c1_c2_c3"}


def latest(rows: DataFrame, keys: list[str] = CELL, order: str = "ingest_seq", keep: list[str] | None = None) -> DataFrame:
    """The last row of each key; partially aggregated, no window over a hot key. Only the columns to keep are read and moved."""
    rest = [c for c in rows.columns if c not in keys and (keep is None or c in keep)]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has left: the wanted rows whose key isn't done. Null keys are equal to none."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def summary(cells: DataFrame, keys: list[str], resamples: int = 10_000) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    sums = cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("verify_valid").alias("s"), rate("parse_valid").alias("parse_rate"), rate("verify_valid").alias("verify_rate"),
        rate("attempts").alias("mean_attempts"), rate("dt").alias("mean_dt"), F.count_if(~F.coalesce("finished", F.lit(True))).alias("unfinished"),
    )
    got = count_interval(sums, resamples)
    return got.select(*keys, "n", "parse_rate", "verify_rate", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "mean_attempts", "mean_dt", "unfinished")


def arms(cells: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per key with each value under each stack: a pivot instead of a self-join. Values are null where the arm is missing."""
    stacks = ("none", "c1", "c1_c2", "c1_c2_c3")
    each = [F.max(F.when(F.col("constraint_stack") == s, v.cast("int"))).alias(f"{name}_{s}") for name, v in values.items() for s in stacks]
    return cells.groupBy(*keys).agg(*each)


def rung_pairs(cells: DataFrame, metric: str = "verify_valid") -> DataFrame:
    """(model, pool, prompt_id, rung, a, b): prompts that both arms of a rung answered."""
    wide = arms(cells, ["model", "pool", "prompt_id"], {"m": F.col(metric)})
    each = [F.struct(F.lit(f"{a}-{b}").alias("rung"), F.col(f"m_{a}").alias("a"), F.col(f"m_{b}").alias("b")) for a, b in RUNGS]
    return wide.select("model", "pool", "prompt_id", F.explode(F.array(*each)).alias("x")).select("model", "pool", "prompt_id", "x.*").filter("a is not null and b is not null")


def flags(cells: DataFrame, known: Column) -> DataFrame:
    """cells with the violation flags of each layer, from the recorded verdicts; v2 to v4 are false where the text doesn't parse."""
    parses = F.coalesce("parse_valid", F.lit(False))
    vocab = F.size(unknown_ops(F.coalesce("generated", F.lit("")), known)) > 0
    verified = parses & F.coalesce("verify_valid", F.lit(False))
    scope = F.coalesce(F.element_at(F.when(F.size("scope_passed_per_try") > 0, F.col("scope_passed_per_try")), -1), F.lit(True))
    cat = F.when(~parses & vocab, "vocab").when(~parses, "syntax").when(verified, "passed").otherwise(error_category(F.col("error")))
    t = cells.withColumn("cat", cat).withColumn("v1", ~parses)
    return (
        t.withColumn("v1_vocab", F.col("cat") == "vocab").withColumn("v1_struct", F.col("v1") & (F.col("cat") != "vocab"))
        .withColumn("v2", parses & (F.col("cat") == "type")).withColumn("v3", parses & (~scope | (F.col("cat") == "type_ssa")))
        .withColumn("v4", parses & ~verified & shape_error(F.col("error")) & ~F.col("cat").isin("type", "type_ssa")).withColumn("verify", verified)
    )


LAYERS = ("v1", "v1_vocab", "v1_struct", "v2", "v3", "v4", "verify")


def flag_rates(flagged: DataFrame, keys: list[str]) -> DataFrame:
    return flagged.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(v).cast("double")), 6).alias(v) for v in LAYERS])


def residual_pairs(flagged: DataFrame) -> DataFrame:
    """(model, pool, prompt_id, layer, a, b): each layer's flag without constraints and under its stack."""
    wide = arms(flagged, ["model", "pool", "prompt_id"], {v: F.col(v) for v in STACK} | {"parse": F.col("parse_valid")})
    each = [F.struct(F.lit(v).alias("layer"), F.col(f"{v}_none").alias("a"), F.col(f"{v}_{s}").alias("b")) for v, s in STACK.items()]
    return wide.select("model", "pool", "prompt_id", F.col("parse_none").alias("free_parses"), F.explode(F.array(*each)).alias("x")).select("model", "pool", "prompt_id", "free_parses", "x.*").filter("a is not null and b is not null")


def subset(rows: DataFrame, which: str, spec_rows: dict[str, int]) -> DataFrame:
    """'all', 'spec' (the first prompts of a pool, spec_rows of them) or 'mined' (the rest); pools without a bound are all spec."""
    if which == "all":
        return rows
    bound = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in spec_rows.items() for x in kv]), F.col("pool")), F.lit(10**9))
    return rows.filter((F.col("prompt_id") < bound) if which == "spec" else (F.col("prompt_id") >= bound))


def internalized(intervals: DataFrame, pp: float = 2.0) -> DataFrame:
    """The verdict: the interval holds 0 and the point is at most pp points."""
    return intervals.withColumn("internalized", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0) & (F.col("point") * 100 <= pp))
