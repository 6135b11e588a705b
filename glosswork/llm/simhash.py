"""SimHash near-dedup by anchor-point covering.

A document's fingerprint is a 128-bit SimHash over its lower-case words, a word that comes n times weighing about
1 + ln n. It is cut into six blocks of 21 or 22 bits, so two fingerprints that differ in at most THRESHOLD = 6 * 3 - 1
bits differ in at most 2 bits of some block (pigeonhole). A block's anchors are the codewords of a linear code with four
check bits of which every non-zero column occurs: a covering code of radius 1. Two blocks at most 2 bits apart have a
point between them at distance 1 from both, and that point has an anchor within 1: so each block is replicated to every
anchor within 1 + 2 / 2 = 2, and every pair within the threshold meets at some anchor, without exception. Members of an
anchor are compared by full 128-bit Hamming distance; what is near becomes a spanning forest, so m near fingerprints
make m - 1 edges and not m * m. Equal fingerprints are one before all this. The edges' connected components are the
groups.

A fingerprint makes about 90 rows. Two unrelated ones meet at an anchor with a chance of about 2 % (their blocks are 4
bits apart), which is what an exact threshold of 17 in 128 bits costs; these comparisons are vectorised.

Defined cases. Null text or null id: never compared, always kept, group_id null. Text without a word: compared by a
hash of the whole text, so only equal ones group. Repeated rows of one id count as copies: one stays. Rows of one id
with different texts are one document of several fingerprints. Ties: the smallest id represents its group. Empty table:
empty result. Columns of any name pass through keep_one().
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, batches, cut, fresh, read, session, stored

#: Bits of each block.
BLOCKS = np.split(np.arange(128), [22, 44, 65, 86, 107])
#: Largest Hamming distance (of 128 bits) of near duplicates: the most that leaves some block within 2 bits.
THRESHOLD = 3 * len(BLOCKS) - 1
#: Anchors of at most so many members are compared by shifts over many anchors at once, larger ones one by one.
SMALL = 64


def _code(length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(check bits of each place, for each syndrome the patterns of at most 2 bits that lead from a point to codewords)."""
    cols = np.arange(length) % 15 + 1
    by: list[list[int]] = [[] for _ in range(16)]
    by[0].append(0)
    for i in range(length):
        by[cols[i]].append(1 << i)
        for j in range(i):
            by[cols[i] ^ cols[j]].append(1 << i | 1 << j)
    return cols, [np.array(v, np.uint64) for v in by]


_CODES = {n: _code(n) for n in {len(b) for b in BLOCKS}}


def anchors(block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into block, anchor) of every value of that many bits and every codeword within distance 2."""
    cols, patterns = _CODES[length]
    b = block.astype(np.uint64)
    syn = np.zeros(len(b), np.int64)
    for i in range(length):
        syn ^= np.where(b >> np.uint64(i) & np.uint64(1), cols[i], 0)
    order = np.argsort(syn, kind="stable")
    bounds = np.searchsorted(syn[order], np.arange(17))
    who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s in range(16):
        rows = order[bounds[s] : bounds[s + 1]]
        where.append((b[rows][:, None] ^ patterns[s][None, :]).ravel())
        who.append(np.repeat(rows, len(patterns[s])))
    return np.concatenate(who), np.concatenate(where)


def values(bits: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The number that the bits of a block make, for rows of 128 bits."""
    return bits[:, block].astype(np.uint64) @ (np.uint64(1) << np.arange(len(block), dtype=np.uint64))


def fingerprints(texts: list[str | None], seen: dict[str, np.ndarray]) -> np.ndarray:
    """(n, 2) uint64; rows of null texts are 0. seen keeps the sign vectors of words."""
    out = np.zeros((len(texts), 2), np.uint64)
    if len(seen) > 200_000:
        seen.clear()
    for i, t in enumerate(texts):
        if t is None:
            continue
        words = Counter(WORD.findall(t.lower()))
        if not words:
            d = xxhash.xxh3_128_intdigest(t.encode())
            out[i] = d >> 64, d & (1 << 64) - 1
            continue
        new = [w for w in words if w not in seen]
        if new:
            raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), np.uint8).reshape(-1, 16)
            for w, v in zip(new, np.unpackbits(raw, axis=1)):
                seen[w] = v
        once = [seen[w] for w, n in words.items() if n == 1]
        votes, total = np.zeros(128, np.int64), 16 * len(once)
        for k in range(0, len(once), 250):  # bytes can't overflow
            votes += 16 * np.add.reduce(np.array(once[k : k + 250]), axis=0, dtype=np.uint8).astype(np.int64)
        often = [(seen[w], round(16 * (1 + math.log(n)))) for w, n in words.items() if n > 1]
        if often:
            weight = np.array([n for _, n in often], np.int64)
            votes += weight @ np.array([v for v, _ in often]).astype(np.int64)
            total += int(weight.sum())
        out[i] = np.packbits(2 * votes > total).view(">u8")
    return out


def fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hi, lo of every document that has an id and a text."""

    def run(tables):
        seen: dict[str, np.ndarray] = {}
        for table in tables:
            for start, texts in batches(table, "t"):
                fp = fingerprints(texts, seen).view(np.int64)
                yield pa.RecordBatch.from_arrays([table.column("id").slice(start, len(texts)), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy())], names=["id", "hi", "lo"])

    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return known.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, hi long, lo long")


def _replicate(tables):
    """One row an anchor: (anchor with the block's number, hi, lo)."""
    for table in tables:
        hi, lo = (np.asarray(table.column(c)).view(np.uint64) for c in ("hi", "lo"))
        for k in range(0, len(hi), 4096):
            h, w = hi[k : k + 4096], lo[k : k + 4096]
            bits = np.unpackbits(np.column_stack([h, w]).astype(">u8").view(np.uint8).reshape(len(h), 16), axis=1)
            for n, block in enumerate(BLOCKS):
                who, where = anchors(values(bits, block), len(block))
                key = (where | np.uint64(n << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h[who].view(np.int64)), pa.array(w[who].view(np.int64))], names=["a", "hi", "lo"])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n vertices, by edges i, j."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_pairs(a: np.ndarray, h: np.ndarray, w: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of members of one anchor that connect what lies within threshold; a is in order."""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    sizes = np.diff(np.r_[starts, len(a)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.repeat(sizes <= SMALL, sizes)
    end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(few)
    for k in range(1, SMALL):
        at = at[at + k < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(h[at] ^ h[at + k]).astype(np.int16) + np.bitwise_count(w[at] ^ w[at + k]) <= threshold]
        left.append(near)
        right.append(near + k)
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        # breadth first: whoever is near to a member leaves the rest
        rest, front = np.arange(s + 1, s + n), [int(s)]
        while len(rest):
            if not front:
                front, rest = [int(rest[0])], rest[1:]
                continue
            x = front.pop()
            near = np.bitwise_count(h[rest] ^ h[x]).astype(np.int16) + np.bitwise_count(w[rest] ^ w[x]) <= threshold
            if near.any():
                left.append(np.full(int(near.sum()), x))
                right.append(rest[near])
                front.extend(rest[near].tolist())
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def _compare(threshold: int):
    def edges(a, h, w):
        i, j = near_pairs(a, h, w, threshold)
        # the same fingerprint at other anchors is one vertex; a component becomes a star
        both, number = np.unique(np.column_stack([h[np.r_[i, j]], w[np.r_[i, j]]]), axis=0, return_inverse=True)
        number = number.ravel()
        root = roots(len(both), number[: len(i)], number[len(i) :])
        child = np.flatnonzero(root != np.arange(len(root)))
        pairs = np.column_stack([both[child], both[root[child]]]).astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].view(np.int64).copy() if len(pairs) else [], pa.int64()) for k in range(4)], names=["h1", "l1", "h2", "l2"])

    def run(tables):
        size, parts = 0, []
        for table in tables:
            a, h, w = np.asarray(table.column("a")), *(np.asarray(table.column(c)).view(np.uint64) for c in ("hi", "lo"))
            if not len(a):
                continue
            parts.append((a, h, w))
            size += len(a)
            if size >= 400_000 and parts[0][0][0] != a[-1]:  # up to the last anchor, which may go on in the next batch
                held = [np.concatenate(x) for x in zip(*parts)]
                end = int(np.searchsorted(held[0], held[0][-1]))
                yield edges(*(x[:end] for x in held))
                parts, size = [tuple(x[end:] for x in held)], len(held[0]) - end
        if size:
            yield edges(*(np.concatenate(x) for x in zip(*parts)))

    return run


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(v, root): the smallest vertex of the connected component of every vertex, by large star and small star.

    The smallest neighbour comes from an aggregation that combines map side and is joined back; the edges are cut after
    each round, and rounds grow with the logarithm of the longest chain."""
    e = cut(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u go to the smallest of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: neighbours below u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(low.select("u", F.col("m").alias("v")).union(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """id, group_id (smallest id of the group), n_rows of the id, for every compared document; stored."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors meet every pair up to {THRESHOLD} bits, no further")
    session(docs)
    fps = cut(fingerprinted(docs, id_col, text_col).groupBy("id", "hi", "lo").agg(F.count(F.lit(1)).alias("n")))
    # a fingerprint's vertex is the smallest id that has it
    firsts = stored(fps.groupBy("hi", "lo").agg(F.min("id").alias("first")))
    by_anchor = firsts.select("hi", "lo").mapInArrow(_replicate, "a long, hi long, lo long").repartition("a").sortWithinPartitions("a")
    pairs = by_anchor.mapInArrow(_compare(threshold), "h1 long, l1 long, h2 long, l2 long").distinct()
    one, two = (firsts.select(F.col("hi").alias(f"h{i}"), F.col("lo").alias(f"l{i}"), F.col("first").alias(f"f{i}")) for i in (1, 2))
    edges = pairs.join(one, ["h1", "l1"]).join(two, ["h2", "l2"]).select(F.col("f1").alias("a"), F.col("f2").alias("b"))
    has = cut(fps.join(firsts, ["hi", "lo"]).select("id", "first", "n"))
    ids = cut(has.groupBy("id").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.sum("n").alias("n")))
    several = ids.where("first <> last").select(F.col("id").alias("i"), F.col("first").alias("b"))
    own = has.join(several, F.col("id") == F.col("i")).select(F.col("first").alias("a"), "b")
    found = stored(components(edges.union(own)))
    out = ids.join(found, F.col("first") == F.col("v"), "left").select(F.col("id").alias(id_col), F.coalesce("root", "first").alias("group_id"), F.col("n").alias("n_rows"))
    return stored(out)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row a compared document: id, group_id, group_size (rows), keep (the group's representative)."""
    d = decisions(docs, id_col, text_col, threshold)
    sizes = d.groupBy("group_id").agg(F.sum("n_rows").alias("group_size"))
    return d.join(sizes, "group_id").select(id_col, "group_id", "group_size", (F.col(id_col) == F.col("group_id")).alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each group; its columns as they are."""
    d = decisions(docs, id_col, text_col, threshold)
    lost, again, n = (fresh(docs, x) for x in ("__gw_lost", "__gw_again", "__gw_n"))
    # null texts were never compared: they stay, whatever becomes of other rows of their id
    compared = F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    out = docs.join(stored(d.where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias(lost))), (F.col(id_col) == F.col(lost)) & compared, "left_anti")
    more = stored(d.where((F.col(id_col) == F.col("group_id")) & (F.col("n_rows") > 1)).select(F.col(id_col).alias(again)))
    if more.isEmpty():
        return out
    here = (F.col(id_col) == F.col(again)) & compared
    # of rows with one id the one of the least content stays; the choice is an aggregation, so a hot id is combined map side
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = out.join(more, here, "left_semi").groupBy(F.col(id_col).alias(n)).agg(F.min_by(columns, F.xxhash64(text_col)).alias("x"))
    return out.join(more, here, "left_anti").union(first.select("x.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
