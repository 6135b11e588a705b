import math

import numpy as np
from glosswork.llm import sharding
from pyspark.sql import functions as F

from .frames import DOCS, clashing, frame, odd, rows


def naive(unit, n, slack):
    left = [[slack] * 3 for _ in range(n)]
    out = []
    for u in unit:
        best = None
        for s in range(n):
            fits = all(left[s][d] >= u[d] - 1e-12 for d in range(3))
            score = sum(left[s][d] * u[d] for d in range(3)) if fits else -sum(max(0, u[d] - left[s][d]) for d in range(3))
            key = (fits, round(score, 12))
            if best is None or key > best[0]:
                best = key, s
        out.append(best[1])
        for d in range(3):
            left[best[1]][d] -= u[d]
    return out


def test_pack_is_the_greedy_dot_product_rule():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        size = rng.integers(0, 1000, (60, 3)).astype(float)
        unit = size / (size.sum(0) / n)
        assert sharding.pack(unit, n).tolist() == naive(unit.tolist(), n, sharding.SLACK)


def loads(out):
    by = {}
    for r in out:
        b = by.setdefault(r["shard_id"], [0, 0, 0])
        for d, v in enumerate((r["bytes"], r["tokens"], 1)):
            b[d] += v
    return np.array(list(by.values()))


def test_a_source_of_very_many_shards_is_even(spark):
    """15,000 shards of one source: no bound on its parts."""
    data = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(" " + "x" * 90)).alias("text"), F.lit("one").alias("source"))
    got = loads(sharding.shards(data, shard_bytes=200).collect())
    assert 15_000 <= len(got) <= 15_050 and got[:, 0].max() <= 1.25 * 200


def test_rows_without_bytes_tokens_or_ids_are_even(spark):
    empty = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("e").alias("source"))
    full = spark.range(400).select((F.col("id") + 9000).alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"), F.lit("f").alias("source"))
    lost = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("g").alias("source"))
    same = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("same "), 100).alias("text"), F.lit("h").alias("source"))
    got = loads(sharding.shards(empty.union(full).union(lost).union(same), shard_bytes=70_000).collect())
    assert got[:, 2].sum() == 7000 and len(got) == 10
    assert (got.max(0) <= 1.3 * got.mean(0)).all()


def test_every_row_is_placed_and_all_three_sizes_balance(spark):
    data = rows(400)
    out = sharding.shards(frame(spark, data), shard_bytes=40_000).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(400))
    by = {}
    for r in out:
        b = by.setdefault(r["shard_id"], [0, 0, 0])
        for d, v in enumerate((r["bytes"], r["tokens"], 1)):
            b[d] += v
    assert len(by) == -(-sum(len(r[1].encode()) for r in data) // 40_000)
    for d in range(3):
        assert max(b[d] for b in by.values()) <= 1.25 * sum(b[d] for b in by.values()) / len(by)


def test_the_query_equals_brute_force(spark):
    data = rows(200, 5) + [r for r in odd() if r[0] != 1004]
    docs = frame(spark, data)
    sb, grain = 20_000, sharding.GRAIN
    h = sharding._hash("doc_id", "text")
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", h.alias("h")).collect()}
    vec = lambda t: (len((t or "").encode()), len((t or "").split()), 1)
    total = [sum(vec(r[1])[d] for r in data) for d in range(3)]
    n = -(-total[0] // sb)
    unit = [x / n for x in total]
    src, k = {}, {}
    for i, t, _, s, _ in data:
        v = src.setdefault(s or "\x00", [0, 0, 0])
        for d in range(3):
            v[d] += vec(t)[d]
    for s, v in src.items():
        k[s] = max(1, math.ceil(max(v[d] / unit[d] for d in range(3)) / grain))
        if k[s] > 1 and k[s] * sharding.FEW_ROWS > v[2]:
            k[s] = 0
    part = lambda i, t, s: (s, hashed[i, t] % k[s] if k[s] else hashed[i, t])
    groups = {}
    for i, t, _, s, _ in data:
        g = groups.setdefault(part(i, t, s or "\x00"), [0, 0, 0])
        for d in range(3):
            g[d] += vec(t)[d] / unit[d]
    assert max(max(g) for g in groups.values()) <= 4 * grain  # none is cut by row
    order = sorted(groups, key=lambda g: (-round(max(groups[g]), 12), g))
    at = dict(zip(order, naive([groups[g] for g in order], n, sharding.SLACK)))
    want = sorted((repr(i), at[part(i, t, s or "\x00")]) for i, t, _, s, _ in data)
    got = sharding.shards(docs, shard_bytes=sb).collect()
    assert sorted((repr(r["doc_id"]), r["shard_id"]) for r in got) == want
    assert sorted((repr(r["doc_id"]), r["shard_id"]) for r in sharding.assign(clashing(spark, data), shard_bytes=sb).collect()) == want


def test_many_pools_have_even_shards(spark):
    out = sharding.shards(frame(spark, rows(3000)), shard_bytes=10_000, pool_groups=300).collect()
    got = loads(out)
    assert len(out) == 3000 and (got.max(0) <= 1.3 * got.mean(0)).all() and (got.min(0) >= 0.3 * got.mean(0)).all()


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    data = odd()
    out = sharding.assign(clashing(spark, data))
    assert out.count() == len(data) and out.columns[-1] == "shard_id" and out.columns[5:7] == ["id", "t"]
    again = sharding.assign(sharding.assign(out))
    assert again.columns[-3:] == ["shard_id", "shard_id_2", "shard_id_3"] and again.count() == len(data)
    named = sharding.assign(clashing(spark, data).withColumnRenamed("k", "SHARD_ID").withColumnRenamed("h", "__gw_h"))
    assert named.columns[-1] == "shard_id_2" and named.count() == len(data)
    assert sharding.assign(frame(spark, [], DOCS)).count() == 0
