"""Rates, intervals and paired differences."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_rate(x: Column) -> Column:
    """Mean of an outcome; NaN over no rows."""
    return F.coalesce(F.avg(x.cast("double")), F.lit(float("nan")))


def draw(b: Column, i: Column, n: Column) -> Column:
    """The i-th index of resample b among n, from a digest: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(b.cast("string"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("long") % n


def resampled(rows: DataFrame, keys: list[str], order: str, values: list[str], resamples: int) -> DataFrame:
    """keys, resample and the mean of each of values over that resample of the group's rows, all values by the same draws.

    Draws are made where the rows are and come back by an equi-join on (keys, index); B * n narrow rows are shuffled once, so keep
    resamples small where groups are large, or use numpy_interval()."""
    w = Window.partitionBy(*keys).orderBy(order)
    idx = rows.select(*keys, *values, (F.row_number().over(w) - 1).cast("long").alias("i"))
    sized = idx.join(idx.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    draws = sized.select(*keys, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).select(*keys, "resample", draw(F.col("resample"), F.col("i"), F.col("n")).alias("i"))
    return draws.join(idx, [*keys, "i"]).groupBy(*keys, "resample").agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values])


def interval(rows: DataFrame, keys: list[str], order: str, value: str, resamples: int = 200, alpha: float = 0.05) -> DataFrame:
    """keys, n, point, ci_low, ci_high: the percentile bootstrap of a mean, with linear quantiles."""
    r = resampled(rows, keys, order, [value], resamples).groupBy(*keys).agg(F.expr(f"percentile({value}, array({alpha / 2}, {1 - alpha / 2}))").alias("q"))
    p = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("point"))
    return p.join(r, keys).select(*keys, "n", "point", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def rank_interval(rows: DataFrame, keys: list[str], order: str, value: str, resamples: int = 200) -> DataFrame:
    """The same resamples, the bounds by rank: the sorted means at positions int(.025 B) and int(.975 B), without interpolation."""
    r = resampled(rows, keys, order, [value], resamples).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("m"))
    return r.select(*keys, F.get("m", F.lit(int(0.025 * resamples))).alias("ci_low"), F.get("m", F.lit(int(0.975 * resamples))).alias("ci_high"))


def paired_interval(pairs: DataFrame, keys: list[str], order: str, a: str, b: str, resamples: int = 200, alpha: float = 0.05) -> DataFrame:
    """keys, n, point, ci_low, ci_high, p_value of mean(a) - mean(b) on rows that hold both arms; p is the share of resamples at or below 0."""
    d = resampled(pairs, keys, order, [a, b], resamples).withColumn("d", F.col(a) - F.col(b))
    q = d.groupBy(*keys).agg(F.expr(f"percentile(d, array({alpha / 2}, {1 - alpha / 2}))").alias("q"), F.avg((F.col("d") <= 0).cast("double")).alias("p_value"))
    p = pairs.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(F.col(a).cast("double")) - F.avg(F.col(b).cast("double"))).alias("point"))
    return p.join(q, keys).select(*keys, "n", "point", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "p_value")


def numpy_interval(rows: DataFrame, keys: list[str], order: str, a: str, b: str | None = None, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0, ranks: bool = False) -> DataFrame:
    """The bootstrap on numpy's generator, for agreement with other numpy code: one group a task, n values each; time goes with resamples * n.
    For benchmarks, whose groups are small: count_interval() and pair_count_interval() hold at any size.

    Draws are made in blocks, which give the same stream as one call. ranks: bounds as in rank_interval()."""
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        x, rng = t[a].to_numpy(float), np.random.default_rng(seed)
        y = None if b is None else t[b].to_numpy(float)
        means, step = np.empty(resamples), max(1, 2**22 // len(x))
        for k in range(0, resamples, step):
            i = rng.integers(0, len(x), size=(min(step, resamples - k), len(x)))
            means[k : k + step] = x[i].mean(axis=1) if y is None else x[i].mean(axis=1) - y[i].mean(axis=1)
        point, p = (x.mean(), None) if y is None else (x.mean() - y.mean(), float((means <= 0).mean()))
        low, high = np.sort(means)[[int(0.025 * resamples), int(0.975 * resamples)]] if ranks else np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({**{k: [t[k].iloc[0]] for k in keys}, "n": [len(x)], "point": [point], "ci_low": [low], "ci_high": [high], "p_value": [p]})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    cols = [*keys, order, a, *([b] if b else [])]
    return rows.select(*dict.fromkeys(cols)).groupBy(*keys).applyInPandas(run, f"{fields}, n long, point double, ci_low double, ci_high double, p_value double")


def uniforms(resamples: int, salt: str) -> np.ndarray:
    """One number in [0, 1) a resample, from a digest: the same on every engine."""
    return np.array([int(hashlib.md5(f"{salt}:{b}".encode()).hexdigest()[:13], 16) for b in range(resamples)]) / float(1 << 52)


def binomials(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """Draws of a binomial by inversion: for each of u the least k whose cumulative probability reaches it. Only the places that have any
    weight are looked at, so time and memory go with the root of n."""
    if n == 0 or p <= 0:
        return np.zeros(len(u), np.int64)
    if p >= 1:
        return np.full(len(u), n, np.int64)
    reach = 12 * math.sqrt(n * p * (1 - p)) + 40
    low, high = max(0, int(n * p - reach)), min(n, int(n * p + reach))
    k = np.arange(low, high + 1)
    top = int(n * p)
    steps = np.log(n - k[:-1]) - np.log(k[1:]) + math.log(p) - math.log1p(-p)  # from one place to the next
    log = np.concatenate([[0.0], np.cumsum(steps)])
    at = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    cumulative = np.cumsum(np.exp(log - log[top - low] + at))
    return low + np.minimum(np.searchsorted(cumulative, u), len(k) - 1)


def count_interval(counts: DataFrame, resamples: int = 10_000, alpha: float = 0.05, ranks: bool = False) -> DataFrame:
    """(.., n, s) -> the same, point, ci_low, ci_high: the percentile bootstrap of the rate s / n of a 0/1 outcome.

    A resample of n outcomes is a binomial draw, so counts are resampled instead of rows: the cost doesn't go with the rows, and no
    group is one task. Linear quantiles; with ranks the sorted rates at int(alpha / 2 * B) and int((1 - alpha / 2) * B). Null for n = 0."""

    @F.pandas_udf("low double, high double")
    def run(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        u, known, out = uniforms(resamples, "rate"), {}, []
        for x in zip(n, s):
            if x not in known:
                known[x] = _bounds(binomials(int(x[0]), x[1] / x[0], u) / x[0], alpha, ranks) if x[0] else (None, None)
            out.append(known[x])
        return pd.DataFrame(out, columns=["low", "high"])

    got = counts.withColumn("_i", run("n", "s"))
    return got.withColumns({"point": F.try_divide("s", "n"), "ci_low": F.col("_i.low"), "ci_high": F.col("_i.high")}).drop("_i")


def _bounds(means: np.ndarray, alpha: float, ranks: bool = False) -> tuple[float, float]:
    if ranks:
        return tuple(np.sort(means)[[int(alpha / 2 * len(means)), int((1 - alpha / 2) * len(means))]])
    return tuple(np.quantile(means, [alpha / 2, 1 - alpha / 2]))


def pair_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) of 0/1 outcomes -> keys, n, up and down: the pairs whose first, or second, arm alone holds."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("up"), F.count_if(F.col("a") < F.col("b")).alias("down"))


def pair_count_interval(counts: DataFrame, resamples: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """(.., n, up, down) -> the same, point, ci_low, ci_high, p_value of mean(a) - mean(b): the paired bootstrap, from counts.

    A resample draws how many pairs differ, then how many of those go up. p_value is the share of resamples at or below 0."""

    @F.pandas_udf("low double, high double, p double")
    def run(n: pd.Series, up: pd.Series, down: pd.Series) -> pd.DataFrame:
        u, v, known, out = uniforms(resamples, "differ"), uniforms(resamples, "up"), {}, []
        for x in zip(map(int, n), map(int, up), map(int, down)):
            if x not in known and x[0]:
                differ = binomials(x[0], (x[1] + x[2]) / x[0], u)
                rise = np.zeros(resamples, np.int64)
                for m in np.unique(differ):
                    rise[differ == m] = binomials(int(m), x[1] / max(x[1] + x[2], 1), v[differ == m])
                means = (2 * rise - differ) / x[0]
                known[x] = (*_bounds(means, alpha), float((means <= 0).mean()))
            out.append(known.get(x, (None, None, None)))
        return pd.DataFrame(out, columns=["low", "high", "p"])

    got = counts.withColumn("_i", run("n", "up", "down"))
    return got.withColumns({"point": F.try_divide(F.col("up") - F.col("down"), F.col("n")), "ci_low": F.col("_i.low"), "ci_high": F.col("_i.high"), "p_value": F.col("_i.p")}).drop("_i")


def value_interval(values: DataFrame, keys: list[str], value: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """rows (keys, value) -> keys, n, point, ci_low, ci_high: the percentile bootstrap of a mean of any values. Equal values are counted
    first, and a resample draws how often each is met; the cost goes with the distinct values of a group, as rates of few trials have."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(value)
        x, c = t[value].to_numpy(float), t["_c"].to_numpy()
        n, rng = int(c.sum()), np.random.default_rng(seed)
        step = max(1, 2**22 // len(x))
        means = np.concatenate([rng.multinomial(n, c / n, size=min(step, resamples - k)) @ x for k in range(0, resamples, step)]) / n
        low, high = _bounds(means, alpha)
        return pd.DataFrame({**{k: [t[k].iloc[0]] for k in keys}, "n": [n], "point": [float(x @ c / n)], "ci_low": [low], "ci_high": [high]})

    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema if f.name in keys)
    return counts.groupBy(*keys).applyInPandas(run, f"{fields}, n long, point double, ci_low double, ci_high double")


def min_detectable_effect(n: int, alpha: float = 0.05, power: float = 0.8, rate: float = 0.5) -> float:
    """The least difference of two rates that n rows an arm can show; infinite for no rows."""
    if n <= 0:
        return float("inf")
    z = NormalDist().inv_cdf
    return (z(1 - alpha / 2) + z(power)) * (2 * rate * (1 - rate) / n) ** 0.5
