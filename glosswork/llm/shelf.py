"""Hash-sharded sorted arrays in the shared folder: 64-bit keys with two 64-bit values, too many for a broadcast.

shelve() writes them with one task a shard; executors map the shards that they ask into memory, so that the operating
system's page cache holds them once a machine and gives them up when memory is short. A key is mixed with the hash of a
tag, so several tables can share a shelf; its top bits name the shard. A bitmap of 16 bits a key in front of each shard
turns most absent keys away after one probe. Other file systems than mounted ones are read through pyarrow.fs.
"""

from __future__ import annotations

import io
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shared

#: Keys of a shard, about.
SHARD_KEYS = 1 << 20
#: Shards that one worker keeps mapped.
OPEN = 256


def local(path: str) -> str | None:
    """The path on a mounted file system, None elsewhere."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def put(path: str, raw: bytes) -> None:
    """Writes a file as a whole: a repeated task replaces it by the same."""
    import os
    import uuid

    if (at := local(path)) is not None:
        part = f"{at}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, at)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_output_stream(at) as f:
            f.write(raw)


def put_array(path: str, a: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, a)
    put(path, out.getvalue())


def get_array(path: str) -> np.ndarray:
    if (at := local(path)) is not None:
        return np.load(at, mmap_mode="r")
    return np.load(io.BytesIO(get(path)))


def get(path: str) -> bytes:
    if (at := local(path)) is not None:
        with open(at, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read()


class Mapped:
    """The last OPEN things opened, by name."""

    def __init__(self, opener):
        self.opener, self.held = opener, OrderedDict()

    def __getitem__(self, name):
        if name not in self.held:
            if len(self.held) >= OPEN:
                self.held.popitem(last=False)
            self.held[name] = self.opener(name)
        self.held.move_to_end(name)
        return self.held[name]


def _mixed(q: np.ndarray, tag: str) -> np.ndarray:
    return mix(mix(q.astype(np.int64).view(np.uint64)) ^ np.uint64(xxhash.xxh3_64_intdigest(tag)))


class Shelf:
    """What executors ask; small enough to travel with a task."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.maps = None

    def __getstate__(self):
        return self.folder, self.bits

    def __setstate__(self, state):
        self.__init__(*state)

    def _open(self, s: int):
        try:
            return get_array(f"{self.folder}/{s}.npy"), get_array(f"{self.folder}/{s}.bits.npy")
        except FileNotFoundError:  # a shard without a key
            return None

    def find(self, q: np.ndarray, tag: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in q that are known, in no order; first values; second values)."""
        if self.maps is None:
            self.maps = Mapped(self._open)
        none = np.zeros(0, np.int64)
        if not len(q):
            return none, none, none
        m = _mixed(q, tag)
        if self.bits:
            order = np.argsort(m)
            at = (m[order] >> np.uint64(64 - self.bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            parts = [(int(at[a]), order[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(at)])]
        else:
            parts = [(0, None)]
        out = []
        for s, who in parts:
            if (found := self.maps[s]) is None:
                continue
            table, bitmap = found
            x = m if who is None else m[who]
            width = np.uint64(len(bitmap) * 8 - 1)
            b = x & width
            maybe = np.flatnonzero(bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
            x = x[maybe]
            keys = table[0].view(np.uint64)
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[at] == x
            at, maybe = at[hit], maybe[hit]
            out.append((maybe if who is None else who[maybe], table[1][at], table[2][at]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def shelve(df: DataFrame, shard_keys: int = SHARD_KEYS) -> Shelf:
    """A shelf of df (tag string, key long, a long, b long); keys are distinct within a tag. df should be cut."""
    folder = shared(df.sparkSession)
    n = df.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / shard_keys)))))

    def spread(tables):
        for t in tables:
            tags = t.column("tag").dictionary_encode()
            q = np.asarray(t.column("key"))
            m, which = np.empty(len(q), np.uint64), np.asarray(tags.indices)
            for k, tag in enumerate(tags.dictionary.to_pylist()):
                m[which == k] = _mixed(q[which == k], tag)
            shard = (m >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(q), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(m.view(np.int64)), t.column("a"), t.column("b")], names=["shard", "m", "a", "b"])

    def write(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        m, a, b = (np.asarray(t.column(c)) for c in ("m", "a", "b"))
        order = np.argsort(m.view(np.uint64))
        width = 1 << max(6, int(np.ceil(np.log2(len(m) * 16))))
        bitmap = np.zeros(width // 8, np.uint8)
        x = m.view(np.uint64) & np.uint64(width - 1)
        np.bitwise_or.at(bitmap, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        put_array(f"{folder}/{s}.npy", np.stack([m[order], a[order], b[order]]))
        put_array(f"{folder}/{s}.bits.npy", bitmap)
        return pa.table({"n": [len(m)]})

    rows = df.select("tag", "key", "a", "b").mapInArrow(spread, "shard int, m long, a long, b long")
    # the written shards are the result; the count drives the tasks
    if n and rows.groupBy("shard").applyInArrow(write, "n long").agg(F.sum("n")).first()[0] != n:
        raise RuntimeError("a shelf was not written in full")
    return Shelf(folder, bits)


def keys_only(df: DataFrame, key: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """df in the form that shelve() takes, with one empty tag."""
    value = lambda c: F.lit(0).cast("long") if c is None else F.col(c).cast("long")
    return df.select(F.lit("").alias("tag"), F.col(key).alias("key"), value(a).alias("a"), value(b).alias("b"))


