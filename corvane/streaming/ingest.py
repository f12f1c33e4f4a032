"""Streaming ingestion of result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.sinks import append_new


def ingest(spark: SparkSession, source: str, schema, sink: str, keys: list[str], checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Appends files that arrive in source to the log at sink, each key once, over restarts too: a micro-batch that is run again
    appends nothing new. Runs until what is there has been read."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, sink, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, time: str, width: str, late: str, keys: list[str], ok: str) -> DataFrame:
    """Rates per tumbling window; rows later than the watermark are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("n_ok")).select(F.col("window.start").alias("start"), *keys, "n", "n_ok")


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
