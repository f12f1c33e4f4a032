"""Problem 8: mixing sources to target weights over a curriculum.

Sizes are tokens of a public tokenizer. The mixture's total is the largest at which every source with tokens can give its target
share within its cap of repeats. Each source has a weight schedule over training time t in [0, 1],
    w(t) = share * (1 + a * (2 t - 1)),   sum of share * a = 0,
so the weights sum to 1 at all times and each integrates to its share; sources of longer documents come later (a > 0).
A source's cumulative demand is D(t) = share * total * (t + a * (t^2 - t)). Its documents stand in an order given by a hash, passed
as often as the demand needs; each copy gets the time at which the demand reaches its middle, by inverting D, and copies are
range-sorted by that time.

The running totals of a source come from BUCKETS ranges of the hash: sums per range, a running sum over at most BUCKETS
ranges, then within a range; no source is one task. Sources without a target, and null sources, have target 0. A target
source without tokens reaches 0 and doesn't bind the others. Empty and null texts have no tokens and aren't placed. A
document is placed at most max_repeats times. Repeated doc_ids are separate documents. Empty tables give targets with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import count_tokens
from corvane.store import table, written

BUCKETS, TILT = 4096, 0.8


def placed(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) -> the same and before: the tokens of the source's documents that stand before it."""
    h = F.xxhash64("source", "doc_id")
    rows = sizes.filter("n_tokens > 0 and source is not null").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned(F.col("h"), 52).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("base"))
    # h is signed: order within a bucket is by h alone, all of whose values there have the same sign.
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inner.join(base, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("inner")).alias("before"))


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: what it has, what is asked of it and the slope a of its schedule. targets is a configuration
    table; sizes is aggregated to a row per source first."""
    have = sizes.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("has"), F.avg("n_tokens").alias("mean_tokens"))
    t = targets.join(have, "source", "left").na.fill(0, ["has", "mean_tokens"])
    every = Window.partitionBy(F.lit(0))  # a row per target source: bounded by the configuration
    able = F.when((F.col("has") > 0) & (F.col("target_share") > 0), F.col("has") * F.col("max_repeats") / F.col("target_share"))
    t = t.withColumn("total", F.coalesce(F.lit(total).cast("double"), F.min(able).over(every), F.lit(0.0)))
    t = t.withColumn("x", F.percent_rank().over(every.orderBy("mean_tokens", "source")))
    mean_x = F.sum(F.col("target_share") * F.col("x")).over(every) / F.sum("target_share").over(every)
    return t.withColumn("a", TILT * (F.col("x") - mean_x)).withColumn("asked", F.least(F.col("target_share") * F.col("total"), F.col("has") * F.col("max_repeats"))).select("source", "target_share", "max_repeats", "has", "asked", "a")


def time_of(y: Column, a: Column) -> Column:
    """t with t + a (t^2 - t) = y, for y in [0, 1]."""
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * y)
    return F.when(F.abs(a) < 1e-9, y).otherwise(2 * y / ((1 - a) + root))  # the stable form of the quadratic's root


def sequence(sizes: DataFrame, plan_: DataFrame) -> DataFrame:
    """(doc_id, source, pass, n_tokens, t): every copy in the mixture and its time. A copy is in if its middle is within the demand."""
    docs = placed(sizes).join(F.broadcast(plan_.filter("has > 0 and asked > 0")), "source")
    half = F.col("before") + F.col("n_tokens") / 2
    copies = F.least(F.col("max_repeats"), F.greatest(F.lit(0), F.floor((F.col("asked") - half) / F.col("has")) + 1)).cast("int")
    out = docs.withColumn("copies", copies).filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select("doc_id", "source", "pass", "n_tokens", time_of((half + F.col("pass") * F.col("has")) / F.col("asked"), F.col("a")).alias("t"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    n = count_tokens(docs.select(F.struct("doc_id", "source").alias("id"), "text"), id_col="id")  # source goes along: ids may repeat or be null
    sizes = written(n.select("doc_id.doc_id", "doc_id.source", "n_tokens"), "sizes")
    return sizes, table(spark, sf_dir, "mix_targets")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: tokens it has and gives, the share reached, and the passes over its documents."""
    sizes, targets = _inputs(spark, sf_dir)
    p = plan(sizes, targets)
    given = sequence(sizes, p).groupBy("source").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_copies"), (F.max("pass") + 1).alias("repeats"))
    got = p.join(given, "source", "left").na.fill(0, ["used", "n_copies", "repeats"])
    all_ = F.sum("used").over(Window.partitionBy(F.lit(0)))  # a row per target source
    return got.select("source", "target_share", F.when(all_ > 0, F.col("used") / all_).otherwise(0.0).alias("share"), "has", "used", "n_copies", F.col("repeats").cast("int").alias("repeats"), "max_repeats")


def p8_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself, range-sorted by training time."""
    sizes, targets = _inputs(spark, sf_dir)
    return sequence(sizes, plan(sizes, targets)).orderBy("t", "source", "doc_id", "pass")


SQL: dict[str, str] = {}
