"""The shared folder, lineage cuts, stored tables and the spread of small inputs, which the operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a Parquet table for each core below which its rows are dealt out: a few row groups would keep as few cores busy.
SPREAD_BYTES = 8 << 20


def shared(spark: SparkSession) -> str:
    """A new folder's name inside the folder of spark.checkpoint.dir, which all executors see; it goes with the driver.

    Only a local session, which has no other machine, may be without that setting and gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glosswork-"))
    path = f"{sc.getCheckpointDir().rstrip('/')}/gw-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read from there: the planner then knows its size and broadcasts it
    only below spark.sql.autoBroadcastJoinThreshold; adaptive execution corrects it where a filter follows."""
    path = f"{shared(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Shuffle files that no plan can read any more go when the driver collects its garbage, which it is asked to do."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def spread(df: DataFrame, path: str) -> DataFrame:
    """df, read from path, over all cores where it is too small to fill them by itself; a large table stays as it is."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if (1 << 17) <= size < SPREAD_BYTES * cores else df
