"""Line dedup: documents probe sharded minimal perfect hashes over the distinct lines.

A line's key is the line without blanks, tabs and carriage returns at its ends. The 64-bit xxhash of every distinct
key of MIN_CHARS characters or more is counted once a document. The distinct hashes are sharded by their top bits and
each shard becomes a minimal perfect hash (levels of bit arrays with rank, about 3.5 bits a key) that indexes two
compact arrays: a 16-bit fingerprint and a count that saturates at 255. Documents then look their lines up in the
arrays; lines of more than MAX_DOCS documents are removed wherever they stand.

A shard is one file of flat arrays in the shared folder, written by the task that builds it. Documents are read once
more; the executors map the shards that a batch asks into memory and probe the arrays directly, a batch's lines shard
after shard. Nothing is broadcast, collected or joined, and texts aren't shuffled: the only shuffle is that of the
counted hashes. An index takes about 3.6 bytes a distinct line.

Defined cases. Null text: n_lines 0, clean_text null. Empty text: one empty line, kept. Lines whose key is shorter
than MIN_CHARS are kept. A line that a document repeats counts once for it. Repeated rows are documents of their own.
An empty table: an empty result. Columns of other names aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, mix, read, session, shared
from .shelf import Mapped, get_array, put_array

MAX_DOCS = 5
MIN_CHARS = 20
#: Distinct hashes of a shard, about.
SHARD_KEYS = 500_000
GAMMA = 2.0
ENDS = " \t\r"


def line_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key)


class Mph:
    """Minimal perfect hash with fingerprints and counts. Level l maps a key to a bit that no other key of it has."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.bits, self.ranks, base, left = [], [], 0, np.unique(keys)
        n = len(left)
        while len(left):
            size = max(64, int(GAMMA * len(left)) + 63 & ~63)
            at = self._at(left, len(self.bits), size)
            hit = np.bincount(at, minlength=size)
            alone = hit[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            self.bits.append(np.packbits(bits))
            # rank samples every 64 bits
            self.ranks.append(base + np.r_[0, np.cumsum(bits)[63:-1:64]].astype(np.uint32))
            base += int(alone.sum())
            left = left[~alone]
        self.print, self.count = np.zeros(n, np.uint16), np.zeros(n, np.uint8)
        slot = self.slots(keys)
        self.print[slot] = keys.astype(np.uint64) & np.uint64(0xFFFF)
        self.count[slot] = np.minimum(counts, 255)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where no level has it."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (packed, rank) in enumerate(zip(self.bits, self.ranks)):
            if not len(todo):
                break
            at = self._at(keys[todo], level, len(packed) * 8)
            hit = packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
            found = at[hit]
            word = found >> 6
            # bits before the place inside its run of 64
            run = packed[(word * 8)[:, None] + np.arange(8)]
            inside = np.cumsum(np.unpackbits(run, axis=1), axis=1)[np.arange(len(found)), found & 63].astype(np.int64) - 1
            out[todo[hit]] = rank[word] + inside
            todo = todo[~hit]
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key; 0 where the fingerprint says that it isn't among the keys."""
        s = self.slots(keys)
        if not len(self.count):
            return np.zeros(len(keys), np.int64)
        ok = (s >= 0) & (self.print[s] == (keys & np.uint64(0xFFFF)))
        return np.where(ok, self.count[s], 0).astype(np.int64)

    def dump(self) -> np.ndarray:
        """All arrays in one: their number, their lengths in bytes, and each from a multiple of 8 on."""
        parts = [*self.bits, *self.ranks, self.print, self.count]
        head = np.array([len(parts), *(p.nbytes for p in parts)], np.int64)
        out = np.zeros(head.nbytes + sum(p.nbytes + 7 & ~7 for p in parts), np.uint8)
        out[: head.nbytes] = head.view(np.uint8)
        at = head.nbytes
        for p in parts:
            out[at : at + p.nbytes] = p.view(np.uint8)
            at += p.nbytes + 7 & ~7
        return out

    @classmethod
    def load(cls, raw: np.ndarray) -> "Mph":
        """The arrays of dump() as views of raw, which may be mapped memory."""
        m = cls.__new__(cls)
        n = int(raw[:8].view(np.int64)[0])
        sizes = raw[8 : 8 * n + 8].view(np.int64).tolist()
        at, parts = 8 * n + 8, []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += size + 7 & ~7
        levels = n // 2 - 1
        m.bits, m.ranks = parts[:levels], [p.view(np.uint32) for p in parts[levels : 2 * levels]]
        m.print, m.count = parts[-2].view(np.uint16), parts[-1]
        return m


def _hashes(text: str, min_chars: int) -> list[int]:
    """Hash of each line, 0 for lines that are too short to count."""
    out = []
    for line in text.split("\n"):
        key = line.strip(ENDS)
        out.append(line_hash(key) or 1 if len(key) >= min_chars else 0)
    return out


def line_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(h, n): distinct line hashes with the number of documents, summed in each task first."""

    def run(tables):
        held: list[np.ndarray] = []

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        size = 0
        for table in tables:
            for _, texts in batches(table, "t"):
                flat = [h for t in texts if t is not None for h in {*_hashes(t, min_chars)} if h]
                held.append(np.array(flat, np.uint64))
                size += len(flat)
                if size > 2_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def build(counts: DataFrame, n_shards: int, folder: str) -> int:
    """Writes a minimal perfect hash a shard; returns the number of lines in them."""

    def run(t: pa.Table) -> pa.Table:
        h = np.asarray(t.column("h")).view(np.uint64)
        put_array(f"{folder}/{t.column('shard')[0].as_py()}.npy", Mph(h, np.asarray(t.column("n"))).dump())
        return pa.table({"n": [len(h)]})

    shard = F.pmod(F.shiftrightunsigned("h", 40), F.lit(n_shards)).cast("int")
    return counts.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class Index:
    """The shards in the shared folder, as a task sees them."""

    def __init__(self, folder: str, n_shards: int):
        self.folder, self.n_shards, self.maps = folder, n_shards, None

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Count of each hash; 0 for the hash 0 and for lines that aren't known."""
        if self.maps is None:
            self.maps = Mapped(lambda s: Mph.load(get_array(f"{self.folder}/{s}.npy")))
        out = np.zeros(len(h), np.int64)
        real = np.flatnonzero(h)
        shard = ((h[real] >> np.uint64(40)) % np.uint64(self.n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            mine = real[order[a:b]]
            out[mine] = self.maps[int(shard[order[a]])].counts(h[mine])
        return out


def _cleaned(texts, hashes, counts, max_docs):
    """(lines, removed, text) of each text, counts flat in the order of hashes."""
    n_lines, removed, clean, k = [], [], [], 0
    for t, hs in zip(texts, hashes):
        if t is None:
            n_lines.append(0), removed.append(0), clean.append(None)
            continue
        c = counts[k : k + len(hs)]
        k += len(hs)
        if (c > max_docs).any():
            lines = [x for x, bad in zip(t.split("\n"), c > max_docs) if not bad]
            n_lines.append(len(hs)), removed.append(len(hs) - len(lines)), clean.append("\n".join(lines))
        else:
            n_lines.append(len(hs)), removed.append(0), clean.append(t)
    return n_lines, removed, clean


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """id, n_lines, n_removed, clean_text of every row."""
    if max_docs > 254:
        raise ValueError("counts saturate at 255; max_docs must be below")
    spark = session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    counts = cut(line_counts(docs, text_col, min_chars))
    n = counts.count()
    n_shards, folder = max(1, -(-n // shard_keys)), shared(spark)
    if build(counts, n_shards, folder) != n:
        raise RuntimeError("the index was not written in full")
    index = Index(folder, n_shards)

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "t"):
                hashes = [[] if t is None else _hashes(t, min_chars) for t in texts]
                out = _cleaned(texts, hashes, index.counts(np.array([h for hs in hashes for h in hs], np.uint64)), max_docs)
                yield pa.RecordBatch.from_arrays([table.column("id").slice(start, len(texts)), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string())))], names=["id", "n_lines", "n_removed", "clean_text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_lines long, n_removed long, clean_text string").withColumnRenamed("id", id_col)


SQL = rf"""
WITH l AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS k, line
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
c AS (SELECT k FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
j AS (SELECT l.*, c.k IS NULL AS stays FROM l LEFT JOIN c USING (k))
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.clean_text, '') END AS clean_text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
                            string_agg(line, chr(10) ORDER BY n) FILTER (stays) AS clean_text FROM j GROUP BY doc_id) x USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
