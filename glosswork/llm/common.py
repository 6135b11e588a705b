"""Shared plumbing of the training-data operators: the shared folder, lineage cuts, stored tables, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 8 << 20
#: Characters that one vectorised step handles at a time; longer texts are one step of their own.
STEP_CHARS = 1_000_000
WORD = re.compile(r"\w+")


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


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
    only below spark.sql.autoBroadcastJoinThreshold."""
    path = f"{shared(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Documents of under SPREAD_BYTES a core are dealt out: their few row groups would keep as few cores busy."""
    path = f"{sf_dir}/{table}.parquet"
    found = spark.read.parquet(path)
    if table != "documents":
        return found
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size, cores = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength(), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if (1 << 17) <= size < SPREAD_BYTES * cores else found


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a number where df has such a column already; Spark's names have no case."""
    taken = {c.lower() for c in df.columns}
    k, out = 1, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def batches(table: pa.RecordBatch, text: str, step: int = STEP_CHARS):
    """(first row, texts) in runs of rows of about step characters; null texts are None."""
    texts = table.column(text).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= step:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_B = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B ** i and B ** -i modulo 2 ** 64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 19)
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        _POW[:] = [np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)].cumprod(dtype=np.uint64) for x in (_B, inverse)]
    return _POW[0][:n], _POW[1][:n]


def rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours, not mixed."""
    n = len(flat)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    total = np.r_[np.uint64(0), np.cumsum(flat * up, dtype=np.uint64)]
    return (total[k:] - total[:-k]) * down[: n - k + 1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-case word of all texts in a row, words of each text); words stand between white space."""
    parts = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), sizes
    raw = np.frombuffer((" ".join(chain.from_iterable(parts)) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    end = np.flatnonzero(raw == 32)
    up, down = powers(len(raw))
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    before = np.r_[np.uint64(0), total[end[:-1]]]
    return mix((total[end] - before) * down[np.r_[0, end[:-1] + 1]]), sizes
