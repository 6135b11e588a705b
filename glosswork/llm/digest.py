"""Document fingerprints: canonical exact digest.

The canonical form is NFKC, case folding, NFKC again, runs of white space as one blank, ends trimmed. Its 128-bit
xxhash groups the documents. Buckets of two or more rows are compared byte by byte: their canonical texts are reduced
to the least and the greatest of the bucket (map-side, so a bucket of a million copies sends one text a task); where
both agree, all agree. Where they don't - a hash collision - the bucket is split by its canonical text.

The digests of all rows are computed once and cut; texts are canonicalised again only where the digest is among those of
two or more rows, and only they travel. The tables of buckets are stored, so the planner broadcasts them by their size
or joins by shuffle.

Defined cases. Null text: no digest, a group of its own with group_id = id and group_size 1. Empty and blank texts
are equal to each other. Repeated rows each count and get a row each. A null id in a group: the least id that is not
null represents it. Empty table: empty result. Columns of other names aren't read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, read, session, stored


def canonical(text: str) -> str:
    t = unicodedata.normalize("NFKC", text)
    return " ".join(unicodedata.normalize("NFKC", t.casefold()).split())


def digests(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """id, hi, lo and (with_text) the canonical text; rows of null text have null hi and lo."""

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "t"):
                canon = [None if t is None else canonical(t) for t in texts]
                raw = b"".join(bytes(16) if c is None else xxhash.xxh3_128_digest(c.encode()) for c in canon)
                d = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)
                null = np.array([c is None for c in canon], bool)
                out = [table.column("id").slice(start, len(texts)), pa.array(d[:, 0].copy(), mask=null), pa.array(d[:, 1].copy(), mask=null)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(canon, pa.string())] if with_text else out, names=["id", "hi", "lo", "c"][: 3 + with_text])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, hi long, lo long" + ", c string" * with_text)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (hex), group_id, group_size, keep for every row; keep marks the rows of the representative's id."""
    session(docs)
    all_rows = cut(digests(docs, id_col, text_col, False))
    buckets = stored(all_rows.where("hi is not null").groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = buckets.select(F.col("hi").alias("h"), F.col("lo").alias("l"))
    texts = digests(docs, id_col, text_col, True).where("hi is not null")
    texts = texts.join(wanted, (texts["hi"] == wanted["h"]) & (texts["lo"] == wanted["l"]), "left_semi")
    broken = stored(texts.groupBy("hi", "lo").agg((F.min("c") == F.max("c")).alias("same")).where("not same").select(F.col("hi").alias("h"), F.col("lo").alias("l")))
    hexed = F.lower(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0")))
    known = buckets.select(F.col("hi").alias("bh"), F.col("lo").alias("bl"), "first", "n")
    ok = all_rows.join(known, (F.col("hi") == F.col("bh")) & (F.col("lo") == F.col("bl")), "left")
    cols = [F.col("id").alias(id_col), hexed.alias("digest"), F.coalesce("first", "id").alias("group_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size")]
    if broken.isEmpty():
        out = ok.select(*cols)
    else:
        same_key = (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l"))
        fine = ok.join(broken, same_key, "left_anti").select(*cols)
        split = texts.join(broken, same_key, "left_semi")
        by_text = split.groupBy("hi", "lo", "c").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        out = fine.union(split.join(by_text, ["hi", "lo", "c"]).select(*cols))
    return out.withColumn("keep", F.col(id_col).eqNullSafe(F.col("group_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
