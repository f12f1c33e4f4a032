"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and the master is local. Where executors
    are other machines, a folder of this one would be no shared one, so an unset one is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _own[app], True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


_tables: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes the tables that written() has made in this process; call it once no result that reads them is needed."""
    n = len(_tables)
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which bounded() broadcasts.
SMALL = 100_000


def bounded(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df for a join: broadcast if it is counted to have at most so many rows, as it is beyond that. For narrow tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
