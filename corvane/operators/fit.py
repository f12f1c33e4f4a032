"""Log-space fits from sums, so that a fit is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_average(sweep: DataFrame, keys: list[str], value: str) -> DataFrame:
    return sweep.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n_seeds"))


def log_fit(points: DataFrame, keys: list[str], x: Column, y: Column, eps: float = 1e-3) -> DataFrame:
    """keys, a, beta, r2, n, n_clipped, degenerate of y = a * x^-beta by least squares of logs; y is clipped at eps; r2 is 1 for flat y."""
    p = points.withColumn("_x", F.log(x)).withColumn("_y", F.log(F.greatest(y, F.lit(eps)))).withColumn("_c", (y <= eps).cast("long"))
    g = p.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("s"), F.regr_intercept("_y", "_x").alias("i"), F.regr_r2("_y", "_x").alias("r"), F.var_pop("_y").alias("v"), F.count("*").alias("n"), F.sum("_c").alias("n_clipped"))
    return g.select(*keys, F.exp("i").alias("a"), (-F.col("s")).alias("beta"), F.when(F.col("v") > 1e-20, F.col("r")).otherwise(1.0).alias("r2"), "n", "n_clipped", (F.col("n_clipped") >= F.col("n") - 1).alias("degenerate"))


def power_law(points: DataFrame, d: Column, size: Column, residual: Column, eps: float = 1e-3) -> DataFrame:
    """a, alpha, beta, r2, n, n_clipped of residual = a * d^alpha * size^-beta, by the normal equations from one pass of centred sums.

    Fewer than three points, or d and size that vary together, give nulls."""
    p = points.select(F.log(d).alias("x"), (-F.log(size)).alias("z"), F.log(F.greatest(residual, F.lit(eps))).alias("y"), (residual <= eps).cast("long").alias("c"))
    cov = lambda u, v: F.covar_pop(u, v)
    s = p.agg(*[F.avg(c).alias("m" + c) for c in "xyz"], *[cov(u, v).alias(u + v) for u, v in ("xx", "zz", "xz", "xy", "zy", "yy")], F.count("*").alias("n"), F.sum("c").alias("n_clipped"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    ok = (F.col("n") >= 3) & (F.abs(det) > 1e-12)
    s = s.withColumn("alpha", F.when(ok, (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det)).withColumn("beta", F.when(ok, (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det))
    fitted = F.col("alpha") * F.col("xy") + F.col("beta") * F.col("zy")
    return s.select(F.exp(F.col("my") - F.col("alpha") * F.col("mx") - F.col("beta") * F.col("mz")).alias("a"), "alpha", "beta", F.when(ok, F.when(F.col("yy") > 1e-20, fitted / F.col("yy")).otherwise(1.0)).alias("r2"), "n", "n_clipped")
