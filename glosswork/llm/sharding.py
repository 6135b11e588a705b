"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents form groups that stay together: a source, cut by a hash of the id (of the text where there is no id) into as
many parts as make each about GRAIN of a shard in bytes, tokens and rows alike, so a hot source spreads whatever its
size. Where parts would hold only a few rows anyway, every id is a part of its own. A part that is still far larger,
because many rows have one id or no id and one text, is cut further by row. A group is a vector (bytes, tokens, rows) in
units of a shard's share of all. Groups, largest first, go to the shard where the dot product of the group with the
residual capacity is highest among those that it fits into; where it fits none, to the one it overfills least.

One packing handles about POOL_GROUPS groups. Groups are hashed into pools of that size, a pool gets as many shards as
its weight asks, rounded up, and all shards of all pools have the same capacity. The pools are packed in parallel
(applyInArrow): the work grows linearly with the corpus and the driver holds three totals.

Defined cases. Null or empty text: 0 bytes, 0 tokens, 1 row. Null source: a source of its own. Repeated rows each count.
Ties of the dot product: the lowest shard; ties of size: by group. An empty table: an empty result. A document larger
than a shard has one that it overfills. assign() passes columns of any name through and adds shard_id, with a number
where the documents have such a column already (names have no case).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, read, session, stored

#: Bytes of text of a full shard.
SHARD_BYTES = 16 << 20
#: A group is at most about this share of a shard.
GRAIN = 1 / 16
POOL_GROUPS = 4096
#: Capacity beyond the even share.
SLACK = 1.02


#: Parts of fewer rows than this on the average are single ids instead.
FEW_ROWS = 16


def pack(unit: np.ndarray, n_shards: int, slack: float = SLACK) -> np.ndarray:
    """Shard of each group (rows of unit: shares of a shard's bytes, tokens, rows), placed in the order given."""
    left = np.full((n_shards, unit.shape[1]), slack)
    at = np.zeros(len(unit), np.int64)
    for i, g in enumerate(unit):
        fits = (left >= g - 1e-12).all(1)
        if fits.any():
            score = np.where(fits, left @ g, -np.inf)
        else:
            score = -np.maximum(g - left, 0).sum(1)
        at[i] = int(np.argmax(np.round(score, 12)))
        left[at[i]] -= g
    return at


def _source(docs: DataFrame, source_col: str) -> Column:
    return F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\x00"))


def _hash(id_col: str, text_col: str) -> Column:
    """63 bits of the id, or of the text where there is no id."""
    i = F.col(f"`{id_col}`")
    return F.shiftrightunsigned(F.when(i.isNull(), F.xxhash64(F.lit("text"), F.col(f"`{text_col}`"))).otherwise(F.xxhash64(i)), 1)


def _row() -> Column:
    """A number for the cut of parts by row: the place of the row in its partition."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(s, h, u, b, t): source, hashes of the id and of the row, bytes and tokens."""
    text = F.col(f"`{text_col}`")
    b, t = F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
    return docs.select(_source(docs, source_col).alias("s"), _hash(id_col, text_col).alias("h"), _row().alias("u"), b.alias("b"), t.alias("t"), *more)


def layout(rows: DataFrame, shard_bytes: int, grain: float, pool_groups: int) -> tuple[DataFrame, DataFrame]:
    """((s, k): parts of a source, 0 for single ids; (s, g, m, j, shard): the shard of cut j of m of a part); stored."""
    one = rows.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("r")).first()
    total = [float(one[c] or 0) for c in "btr"]
    n_shards = max(1, -(-int(total[0]) // shard_bytes))
    unit = [x / n_shards if x else 1.0 for x in total]
    share = lambda: F.greatest(*[F.col(c) / u for c, u in zip("btr", unit)])
    sums = [F.sum("b").alias("b"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("r"), F.max("b").alias("mb"), F.max("t").alias("mt")]
    k = F.greatest(F.lit(1), F.ceil(share() / grain))
    parts = stored(rows.groupBy("s").agg(*sums).select("s", F.when((k > 1) & (k * FEW_ROWS > F.col("r")), 0).otherwise(k).cast("long").alias("k")))
    groups = rows.join(parts, "s").groupBy("s", part(F.col("h"), F.col("k")).alias("g")).agg(*sums)
    # by row, as long as one row doesn't make up the part
    room = F.least(F.col("r"), *[F.floor(F.col(c) / F.greatest(F.col(f"m{c}"), F.lit(1))) + F.when(F.col(c) == 0, F.col("r")).otherwise(0) for c in "bt"])
    m = F.when(share() > 4 * grain, F.greatest(F.lit(1), F.least(F.ceil(share() / grain), room))).otherwise(1)
    pieces = cut(groups.withColumn("m", m.cast("long")).select("s", "g", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"), *[(F.col(c) / F.col("m") / u).alias(c) for c, u in zip("btr", unit)]))
    pools = max(1, -(-pieces.count() // pool_groups))
    pooled = cut(pieces.withColumn("pool", F.pmod(F.xxhash64("s", "g", "j"), F.lit(pools))))
    # a pool of at most so many groups has its weight's share of the shards
    weight = (F.sum("b") + F.sum("t") + F.sum("r")) / F.greatest(F.lit(1), F.lit(sum(x > 0 for x in total)))
    sizes = stored(pooled.groupBy("pool").agg(F.greatest(F.lit(1), F.ceil(F.round(weight, 6))).cast("long").alias("n")))
    first = stored(sizes.select("pool", "n", (F.sum("n").over(Window.orderBy("pool")) - F.col("n")).alias("first")))

    def run(t: pa.Table) -> pa.Table:
        size = np.column_stack([np.asarray(t.column(c)) for c in "btr"])
        names = list(zip(t.column("s").to_pylist(), t.column("g").to_pylist(), t.column("j").to_pylist()))
        big = np.round(size.max(1), 12)
        order = np.array(sorted(range(len(names)), key=lambda i: (-big[i], names[i])))
        shard = np.empty(len(names), np.int64)
        shard[order] = pack(size[order], t.column("n")[0].as_py()) + t.column("first")[0].as_py()
        return pa.table([t.column("s"), t.column("g"), t.column("m"), t.column("j"), pa.array(shard)], names=["s", "g", "m", "j", "shard"])

    placed = pooled.join(first, "pool").groupBy("pool").applyInArrow(run, "s string, g long, m long, j long, shard long")
    return parts, stored(placed)


def part(h: Column, k: Column) -> Column:
    """The part of an id: its hash itself where every id is a part."""
    return F.when(k == 0, h).otherwise(F.pmod(h, F.greatest(k, F.lit(1))))


def located(keyed: DataFrame, parts: DataFrame, placed: DataFrame, s: str, h: str, u: str, out: str) -> DataFrame:
    """keyed with the shard of each row; s, h, u: its columns of source and hashes."""
    k, g, m, ps, gs, gg, j = (fresh(keyed, f"__gw_{x}") for x in ("parts", "part", "cuts", "ps", "gs", "gg", "j"))
    keyed = keyed.join(parts.select(F.col("s").alias(ps), F.col("k").alias(k)), F.col(s) == F.col(ps)).withColumn(g, part(F.col(h), F.col(k)))
    # a part's first cut says how many there are
    lists = placed.groupBy("s", "g").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("j", "shard"))).alias("x"))
    lists = stored(lists.select(F.col("s").alias(gs), F.col("g").alias(gg), F.col("m").alias(m), F.transform("x", lambda x: x["shard"]).alias(j)))
    at = F.get(F.col(j), F.pmod(F.col(u), F.col(m)).cast("int"))
    return keyed.join(lists, (F.col(s) == F.col(gs)) & (F.col(g) == F.col(gg))).withColumn(out, at)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_bytes: int = SHARD_BYTES, grain: float = GRAIN, pool_groups: int = POOL_GROUPS) -> DataFrame:
    """docs, its columns as they are, and the shard of each row."""
    session(docs)
    parts, placed = layout(cut(measured(docs, id_col, text_col, source_col)), shard_bytes, grain, pool_groups)
    name = fresh(docs, "shard_id")
    s, h, u, out = (fresh(docs, f"__gw_{x}") for x in ("s", "h", "u", "at"))
    keyed = docs.withColumns({s: _source(docs, source_col), h: _hash(id_col, text_col), u: _row()})
    return located(keyed, parts, placed, s, h, u, out).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(out).alias(name))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_bytes: int = SHARD_BYTES, grain: float = GRAIN, pool_groups: int = POOL_GROUPS) -> DataFrame:
    """id, source, bytes, tokens, shard_id of every row; texts are read once."""
    session(docs)
    rows = cut(measured(docs, id_col, text_col, source_col, F.col(f"`{id_col}`").alias("i"), F.col(f"`{source_col}`").alias("from")))
    parts, placed = layout(rows, shard_bytes, grain, pool_groups)
    out = located(rows, parts, placed, "s", "h", "u", "at")
    return out.select(F.col("i").alias(id_col), F.col("from").alias(source_col), F.col("b").alias("bytes"), F.col("t").alias("tokens"), F.col("at").alias("shard_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))
