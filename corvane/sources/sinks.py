"""Sinks: appended logs, replaced rows and partitions, content caches, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key isn't in the log yet, one row a key; the number appended. A rerun appends nothing. Of rows that share
    a key, the one with the least digest of its columns is kept, on every run the same."""
    done = _read(rows.sparkSession, path, rows.schema).select(*keys).distinct()
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_x")).select(*keys, "_x.*").select(*rows.columns) if rest else rows.dropDuplicates(keys)
    fresh = one.join(done, keys, "left_anti").persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """An upsert by partition: the partitions that rows has are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_tagged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new brings, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cached_call(rows: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """rows joined to compute's result by key, through a content cache at path: each distinct missing key is computed once and
    appended. compute takes the missing rows (one a key) and returns (key, ..) of the schema."""
    spark = rows.sparkSession
    wanted = rows.dropDuplicates([key])
    missing = wanted.join(_read(spark, path, schema).select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return rows.join(_read(spark, path, schema).dropDuplicates([key]), key, "left")


def markdown(report: DataFrame, limit: int = 1000) -> str:
    """A report as a Markdown table; reports are small, and limit keeps a mistake from reaching the driver."""
    rows = report.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(report.columns), line("---" for _ in report.columns), *(line(r) for r in rows)])


def write_by(rows: DataFrame, path: str, column: str) -> None:
    rows.write.mode("overwrite").partitionBy(column).parquet(path)
