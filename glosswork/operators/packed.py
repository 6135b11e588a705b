"""Pairs of tokens counted from a packed corpus in the shared folder, without a shuffle of pairs.

pack() writes each document once as sorted token ids, and for each token the documents that hold it, in two bytes each;
ids go from the most frequent token to the rarest. A task takes a range of left tokens, gathers the documents of each
from the mapped files and counts there all tokens that they hold: a token's whole row of partners is in one place, is
summed up or filtered by a kernel, and is gone. So disk grows with the occurrences, not with the pairs; memory with one row."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..llm.shelf import get_array, local, put_array
from ..runtime import dropped, freed, setting, shared, stored
from .stats import near_codes, near_pairs, near_pieces

#: Occurrences in a shard, and documents, whose numbers there have two bytes; pairs of a task, of a batch of small rows,
#: and from which a row is counted alone; ids under COMMON are counted in an array, which the processor's cache holds,
#: and the rarer ones by sorting; the longest rows are gathered in pieces, whatever the token's documents.
SHARD, DOCS, TASK, BATCH, ALONE, COMMON, PIECE = 2_000_000, 1 << 16, 400_000_000, 120_000, 40_000, 32_768, 1_000_000
LOW = (1 << 32) - 1


def _save(path: str, a: np.ndarray) -> None:
    """A repeated task replaces a file by the same."""
    if (at := local(path)) is None:
        return put_array(path, a)
    part = f"{at}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, at)


_OPEN: dict[str, np.ndarray] = {}


class Packed:
    """What tasks need to find the files; small enough to travel with them. n: documents; size: tokens."""

    def __init__(self, folder: str, n: int, size: int, shards: list[str], bounds: list[int]):
        self.folder, self.n, self.size, self.shards, self.bounds = folder, n, size, shards, bounds

    def array(self, name: str) -> np.ndarray:
        """Opened once a worker, which keeps the files of one packed corpus."""
        path = f"{self.folder}/{name}.npy"
        if path not in _OPEN:
            if _OPEN and not next(iter(_OPEN)).startswith(f"{self.folder}/"):
                _OPEN.clear()
            _OPEN[path] = get_array(path).view(np.ndarray)
        return _OPEN[path]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of token numbers, -1 where there is none."""
        if not self.size or not len(numbers):
            return np.full(len(numbers), -1, np.int64)
        known = self.array("known")
        at = np.minimum(np.searchsorted(known, numbers), self.size - 1)
        return np.where(known[at] == numbers, self.array("known_id")[at], -1).astype(np.int64)

    def names(self, ids: np.ndarray) -> pa.Array:
        ends, data, rank = self.array("ends"), self.array("letters"), self.array("rank")
        every = pa.LargeStringArray.from_buffers(self.size, pa.py_buffer(ends), pa.py_buffer(data))
        return every.take(pa.array(rank[ids].astype(np.int64))).cast(pa.string())


def vocabulary(sets: DataFrame, floor: int = 1) -> tuple[Packed, DataFrame]:
    """(a packed corpus without documents, (token, df) of its tokens); sets: v, arrays of distinct tokens, stored."""
    folder, n = shared(sets.sparkSession), sets.count()
    words = stored(sets.select(F.size("v").alias("s"), F.explode("v").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("s").alias("w")).where(F.col("df") >= floor))

    def written_out(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, letters, number, df, w, far = [np.zeros(1, np.int64)], [], [], [], [], 0
        for t in tables:
            names = t.column("token").cast(pa.large_binary())
            off = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1 + names.offset)[names.offset :]
            letters.append(np.frombuffer(names.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].copy())
            ends.append(off[1:] - off[0] + far)
            far = int(ends[-1][-1])
            for held, c, kind in ((number, "number", np.int64), (df, "df", np.int32), (w, "w", np.float64)):
                held.append(t.column(c).to_numpy().astype(kind))
        size = sum(len(x) for x in number)
        if size:
            _save(f"{folder}/ends.npy", np.concatenate(ends))
            _save(f"{folder}/letters.npy", np.concatenate(letters))
            del ends, letters
            number, df, w = np.concatenate(number), np.concatenate(df), np.concatenate(w)
            order = np.argsort(-df, kind="stable")  # id -> place by name
            _save(f"{folder}/rank.npy", order.astype(np.int32))
            _save(f"{folder}/df.npy", df[order].astype(np.int64))
            _save(f"{folder}/number.npy", number[order])
            by = np.argsort(number[order], kind="stable")
            known = number[order][by]
            if (known[1:] == known[:-1]).any():
                raise ValueError("two tokens have one number")
            _save(f"{folder}/known.npy", known)
            _save(f"{folder}/known_id.npy", by.astype(np.int32))
            total = np.cumsum(w[order])
            parts = int(max(48, total[-1] // TASK + 1))
            edges = np.unique(np.r_[0, np.searchsorted(total, total[-1] * np.arange(1, parts) / parts), size])
        else:
            edges = np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges.astype(np.int64))], names=["edge"])

    made = words.select("token", F.xxhash64("token").alias("number"), "df", "w").orderBy("token").coalesce(1).mapInArrow(written_out, "edge long")
    bounds = sorted(r["edge"] for r in made.collect()) or [0]
    return Packed(folder, n, bounds[-1], [], bounds), words.select("token", "df")


def pack(corpus: DataFrame, floor: int = 1, tokens: str = "tokens") -> tuple[Packed, DataFrame]:
    """(the packed corpus, (token, df) of its tokens): tokens of fewer than floor documents are left out; N counts all."""
    # in order, and without the first letters that a token shares with the one before it
    with setting(corpus.sparkSession, "parquet.writer.version", "v2"):
        sets = stored(corpus.select(F.sort_array(F.array_distinct(F.filter(tokens, lambda x: x != ""))).alias("v")))
    out = pack_sets(sets, floor)
    dropped(sets)
    return out


def pack_sets(sets: DataFrame, floor: int = 1, tokens: str = "v") -> tuple[Packed, DataFrame]:
    """pack() of a stored table of arrays of distinct tokens; it stays."""
    sets = sets.select(F.col(tokens).alias("v"))
    sets.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    out, words = vocabulary(sets, floor)
    folder = out.folder
    freed(sets.sparkSession)  # the vocabulary's shuffles

    def shards(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, held, size = TaskContext.get().partitionId(), [], [], 0

        def write():
            name = f"{part}-{len(done)}"
            lists = [(np.asarray(x.flatten()), np.asarray(x.value_lengths().fill_null(0)).astype(np.int64)) for x in held]
            ids = out.ids(np.concatenate([x for x, _ in lists]))
            doc = np.repeat(np.arange(sum(len(k) for _, k in lists)), np.concatenate([k for _, k in lists]))
            key = np.sort(((doc << 32) | ids)[ids >= 0])
            doc, ids = key >> 32, key & LOW
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
            inverse = np.sort((ids << 32) | np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)])))
            t = inverse >> 32
            new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
            for what, a in (("ids", ids.astype(np.int32)), ("off", np.r_[starts, len(ids)]), ("doc", (inverse & LOW).astype(np.uint16)), ("tok", t[new].astype(np.int32)), ("beg", np.r_[new, len(t)].astype(np.uint32))):
                _save(f"{folder}/{name}.{what}.npy", a)
            done.append(name)

        for t in tables:
            # a batch may be large
            step = min(4096, DOCS)
            for a in range(0, t.num_rows, step):
                held.append(t.column("h").slice(a, step))
                size += len(held[-1].flatten())
                if size > SHARD or (len(held) + 1) * step > DOCS:
                    write()
                    held, size = [], 0
        if size:
            write()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["shard"])

    if out.size:
        out.shards = sorted(r["shard"] for r in sets.select(F.transform("v", lambda x: F.xxhash64(x)).alias("h")).mapInArrow(shards, "shard string").collect())
    return out, words


#: left ids, ends of their rows, partners' ids and documents shared -> a batch to return, or none.
Kernel = Callable[[Packed, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch | None]


def rows(spark: SparkSession, packed: Packed, kernel: Kernel, schema: str, half: bool = False, only: str | None = None, head: int = 0, alone: Kernel | None = None) -> DataFrame:
    """kernel over the rows of all left tokens, or of those that the stored mask only names; half: partners of a smaller
    id alone, so that each pair comes once; head: partners of ids under head alone; alone: what becomes of tokens
    without a partner."""
    edges = packed.bounds

    def run(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for b in t.column("id").to_pylist():
                yield from _block(packed, edges[b], edges[b + 1], kernel, half, only, head, alone)

    blocks = max(len(edges) - 1, 0)
    return spark.range(0, blocks, 1, max(blocks, 1)).mapInArrow(run, schema)


def _places(flat: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where each id stands between start and end, where flat is in order and holds it: all halved at once."""
    end = end - 1
    while (open_ := start < end).any():
        mid = (start + end) >> 1
        less = open_ & (flat[mid] < ids)
        start, end = np.where(less, mid + 1, start), np.where(open_ & ~less, mid, end)
    return start


def _block(packed: Packed, a: int, b: int, kernel: Kernel, half: bool, only: str | None, head: int, alone: Kernel | None) -> Iterator[pa.RecordBatch]:
    mask = get_array(only) if only else None
    if mask is not None and not mask[a:b].any():
        return
    flat, parts = [], []
    for s, name in enumerate(packed.shards):
        tok, beg, off = (packed.array(f"{name}.{x}") for x in ("tok", "beg", "off"))
        flat.append(packed.array(f"{name}.ids"))
        lo, hi = np.searchsorted(tok, [a, b])
        ids = np.repeat(tok[lo:hi].astype(np.int64), np.diff(beg[lo : hi + 1]))
        doc = packed.array(f"{name}.doc")[beg[lo] : beg[hi]].astype(np.int64)
        if mask is not None:
            ids, doc = (x[mask[ids]] for x in (ids, doc)) if len(ids) else (ids, doc)
        start, end = off[doc], off[doc + 1]
        if half:
            end = _places(flat[-1], ids, start, end)
        parts.append((ids, np.full(len(ids), s), start, np.minimum(end, start + head) if head else end))
    ids, shard, start, end = (np.concatenate([p[k] for p in parts]) for k in range(4)) if parts else (np.zeros(0, np.int64),) * 4
    order = np.argsort(ids, kind="stable")
    ids, shard, start, end = ids[order], shard[order], start[order], end[order]
    size = end - start
    new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    ends = np.r_[new[1:], len(ids)]
    total = np.r_[0, np.cumsum(size)]
    work = total[ends] - total[new]
    left = ids[new]

    def gathered(p: int, q: int) -> np.ndarray:
        return np.concatenate([flat[s][x:y] for s, x, y in zip(shard[p:q].tolist(), start[p:q].tolist(), end[p:q].tolist())]) if q > p else np.zeros(0, np.int32)

    def given(own: np.ndarray, count: np.ndarray, j: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if alone is not None and (none := own[count == 0]).size:
            e = np.zeros(0, np.int64)
            yield alone(packed, none, np.zeros(len(none), np.int64), e, e)
        own, count = own[count > 0], count[count > 0]
        if len(own) and (out := kernel(packed, own, np.cumsum(count), j, n)) is not None and out.num_rows:
            yield out

    r, cum = 0, np.r_[0, np.cumsum(work)]
    while r < len(left):
        if work[r] >= ALONE:
            if work[r] >= packed.size:
                n, at, most = np.zeros(packed.size, np.int64), new[r], max(PIECE, min(4 * packed.size, 8 * PIECE))
                while at < ends[r]:
                    to = min(ends[r], max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1))
                    x = gathered(at, to)
                    n += np.bincount(x[x < head] if head else x, minlength=packed.size)
                    at = to
                j = np.flatnonzero(n)
                n = n[j]
            else:
                x = gathered(new[r], ends[r])
                if head:
                    x = x[x < head]
                n = np.bincount(x[x < COMMON])
                j = np.flatnonzero(n)
                n = n[j]
                if packed.size > COMMON:
                    x = x[x >= COMMON]
                    x.sort()
                    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                    j, n = np.r_[j, x[at]], np.r_[n, np.diff(np.r_[at, len(x)])]
            if not half:
                other = j != left[r]
                j, n = j[other], n[other]
            yield from given(left[r : r + 1], np.array([len(j)]), j, n)
            r += 1
            continue
        stop = int(np.searchsorted(cum, cum[r] + BATCH, "right")) - 1
        stop = max(stop, r + 1)
        big = np.flatnonzero(work[r:stop] >= ALONE)
        stop = r + int(big[0]) if len(big) else stop
        stop = min(stop, len(left), r + 50_000)
        x = gathered(new[r], ends[stop - 1])
        key = (np.repeat(np.arange(stop - r), work[r:stop]) << 32) | x
        if head:
            key = key[x < head]
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.r_[at, len(key)]), key[at]
        i, j = key >> 32, key & LOW
        if not half:
            other = j != left[r:stop][i]
            i, j, n = i[other], j[other], n[other]
        yield from given(left[r:stop], np.bincount(i, minlength=stop - r), j, n)
        r = stop


# what kernels share


def each(ends: np.ndarray) -> np.ndarray:
    """The row number of each partner."""
    return np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))


def counts(ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, ends])


def over(f, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """f.reduceat over the rows, none of which is empty."""
    return f.reduceat(x, np.r_[0, ends[:-1]])


class Scores:
    """NPMI or PMI of counts, with the logarithms of all document frequencies looked up."""

    def __init__(self, packed: Packed, normal: bool = True):
        self.n, self.normal, self.df = packed.n, normal, packed.array("df")
        self.of_df, self.of_n = np.log(self.df + 1.0), np.log(np.arange(int(self.df[0]) + 1) + 1.0)

    def __call__(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """i: a number, or one for each partner."""
        of_n, of_all = self.of_n[n], np.log(float(self.n))
        up = of_n + (of_all - self.of_df[i])
        up -= self.of_df[j]
        if not self.normal:
            return up
        width = of_all - of_n
        full = n + 1 == self.n
        if full.any():
            return np.where(full, 0.0, up / np.where(full, 1.0, width))
        return up / width

    def exact(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same by the formula as it stands, for the few that are returned."""
        up = np.log(((n + 1.0) * self.n) / ((self.df[i] + 1.0) * (self.df[j] + 1.0)))
        if not self.normal:
            return up
        width = np.log((n + 1.0) / self.n)
        return np.where(width == 0, 0.0, up / np.where(width == 0, 1.0, -width))

    def rows(self, left: np.ndarray, ends: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self(left[0] if len(left) == 1 else np.repeat(left, np.diff(np.r_[0, ends])), j, n)


_SCORES: dict = {}


def scores(packed: Packed, normal: bool = True) -> Scores:
    """Made once a worker."""
    key = packed.folder, normal
    if key not in _SCORES:
        _SCORES.clear()
        _SCORES[key] = Scores(packed, normal)
    return _SCORES[key]


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def supported(least: int, score: float | None = None, normal: bool = True) -> Kernel:
    """t1 < t2, n, score of the pairs that least documents share, of that score at least. For half rows."""

    def kernel(p: Packed, left, ends, j, n):
        keep = n >= least
        if not keep.any():
            return None
        i, j, n = left[each(ends)[keep]], j[keep], n[keep]
        s = scores(p, normal).exact(i, j, n)
        if score is not None:
            i, j, n, s = (x[s >= score] for x in (i, j, n, s))
        rank = p.array("rank")
        up = rank[i] < rank[j]
        return batch(t1=p.names(np.where(up, i, j)), t2=p.names(np.where(up, j, i)), n=n.astype(np.int64), score=s)

    return kernel


def nearest(k: int) -> Kernel:
    """token, neighbor, n, score, rank: the k best partners of each token; ties by name."""

    def kernel(p: Packed, left, ends, j, n):
        name, take, place = p.array("rank"), [], []
        s = np.round(scores(p).rows(left, ends, j, n), 9)
        a = 0
        for b in ends.tolist():
            x = s[a:b]
            c = np.flatnonzero(x >= np.partition(x, b - a - k)[b - a - k]) if b - a > k else np.arange(b - a)
            c = c[np.lexsort((name[j[a + c]], -x[c]))[:k]]
            take.append(a + c)
            place.append(np.arange(1, len(c) + 1))
            a = b
        i = np.repeat(left, [len(x) for x in take])
        at = np.concatenate(take)
        return batch(token=p.names(i), neighbor=p.names(j[at]), n=n[at].astype(np.int64), score=scores(p).exact(i, j[at], n[at]), rank=np.concatenate(place).astype(np.int64))

    return kernel


NEAREST = "token string, neighbor string, n long, score double, rank long"
SUPPORTED = "t1 string, t2 string, n long, score double"


def among(packed: Packed, groups: DataFrame) -> Kernel:
    """t1, t2, n, score of the pairs of tokens that a group has (query_id, token). For half rows."""
    g = groups.select("query_id", F.xxhash64("token").alias("h")).distinct()
    pairs = g.join(g.withColumnRenamed("h", "h2"), "query_id").where("h < h2").select("h", "h2").distinct()

    def fill(t):
        i, j = (packed.ids(t.column(c).to_numpy()) for c in ("h", "h2"))
        good = (i >= 0) & (j >= 0)
        return {"pairs": np.r_[np.unique((np.maximum(i, j) << 32 | np.minimum(i, j))[good]), np.iinfo(np.int64).max]}

    path = written(packed, pairs, fill)["pairs"].rpartition("/")[2].removesuffix(".npy")

    def kernel(p: Packed, left, ends, j, n):
        known, key = p.array(path), left[each(ends)].astype(np.int64) << 32 | j
        keep = known[np.searchsorted(known, key)] == key
        if not keep.any():
            return None
        i, j, n = left[each(ends)[keep]], j[keep], n[keep]
        up = p.array("rank")[i] < p.array("rank")[j]
        return batch(t1=p.names(np.where(up, i, j)), t2=p.names(np.where(up, j, i)), n=n.astype(np.int64), score=scores(p).exact(i, j, n))

    return kernel


def linked(least: int, score: float) -> Kernel:
    """a, b: pairs of ids of that support and score. For half rows."""

    def kernel(p: Packed, left, ends, j, n):
        keep = n >= least
        i, j, n = left[each(ends)[keep]], j[keep], n[keep]
        good = scores(p).exact(i, j, n) >= score
        return batch(a=i[good], b=j[good]) if good.any() else None

    return kernel


def forest(edges: DataFrame, most: int = 2_000_000, parts: int = 0) -> DataFrame:
    """(a, b): edges that connect what those of a task connect, one a node at most. parts:
    tasks that share the partitions, so that what is left grows with the nodes, not with the nodes times the partitions."""

    def reduced(held):
        i, j = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        u, x = np.unique(np.r_[i, j], return_inverse=True)
        root, x, y = np.arange(len(u)), x[: len(i)], x[len(i) :]
        while True:
            a, b = root[x], root[y]
            if (a == b).all():
                far = root != np.arange(len(u))
                return u[far], u[root[far]]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]

    def run(tables):
        held, size, limit = [], 0, most
        for t in tables:
            held.append((t.column("a").to_numpy(), t.column("b").to_numpy()))
            size += t.num_rows
            if size > limit:
                held = [reduced(held)]
                size = len(held[0][0])
                limit = max(most, 2 * size)
        if held:
            a, b = reduced(held)
            yield batch(a=a, b=b)

    edges = edges.select("a", "b")
    return (edges.coalesce(parts) if parts else edges).mapInArrow(run, "a long, b long")


def written(packed: Packed, rows: DataFrame, fill: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, str]:
    """Arrays of the vocabulary's length, made of a table by one task and stored: their paths by name."""
    tag = uuid.uuid4().hex

    def run(tables):
        tables = list(tables)
        columns = [pa.chunked_array([t.column(k) for t in tables], f.type) for k, f in enumerate(schema)]
        for name, a in fill(pa.Table.from_arrays(columns, schema=schema)).items():
            _save(f"{packed.folder}/{name}-{tag}.npy", a)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    schema = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in rows.schema.fields])
    names = [r["name"] for r in rows.coalesce(1).mapInArrow(run, "name string").collect()]
    return {name: f"{packed.folder}/{name}-{tag}.npy" for name in names}


def mask(packed: Packed, tokens: DataFrame, numbers: bool = False) -> str:
    """The path of a stored mask over the ids, true for the tokens (column token) that there are."""

    def fill(t):
        out = np.zeros(packed.size, bool)
        ids = packed.ids(t.column("h").to_numpy())
        out[ids[ids >= 0]] = True
        return {"mask": out}

    h = F.col("token") if numbers else F.xxhash64("token")
    return written(packed, tokens.select(h.alias("h")).distinct(), fill)["mask"]


def admitted(packed: Packed, tokens: DataFrame, floor: int) -> tuple[int, str]:
    """(how many ids there are of at least floor documents, all of them under that number; a mask of those among the
    tokens). One at least is told, as 0 would stand for all; where there is none, the mask is empty."""

    def fill(t):
        many = int((packed.array("df") >= floor).sum()) if packed.size else 0
        out = np.zeros(packed.size, bool)
        ids = packed.ids(t.column("h").to_numpy())
        out[ids[(ids >= 0) & (ids < many)]] = True
        return {"mask": out, "many": np.array([max(many, 1)])}

    at = written(packed, tokens.select(F.xxhash64("token").alias("h")).distinct(), fill)
    return int(get_array(at["many"])[0]), at["mask"]


def skip_links(corpus: DataFrame, support: int, tokens: str = "tokens", window: int = 5) -> tuple[DataFrame, int]:
    """(a < b, n, df1, df2) of the tokens fewer than window places apart in at least support documents, and N.

    Tokens of fewer documents have no such pair: they keep their places but are paired with none. Pairs are counted as
    numbers, and those that are left are named from the mapped vocabulary, without a join."""
    spark = corpus.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    corpus = stored(corpus.select(F.col(tokens).alias("t")))
    p, _ = vocabulary(corpus.select(F.array_distinct(F.filter("t", lambda x: x != "")).alias("v")), support)

    def count(tables):
        for held in near_pieces(tables):
            code, doc, numbers = near_codes(held)
            ids = p.ids(numbers.to_numpy())
            known = np.flatnonzero(ids >= 0)
            of = np.full(len(ids), -1, np.int64)
            of[known] = np.arange(len(known))
            pair, n = np.unique(near_pairs(of[code], doc, window, False), return_counts=True)
            i, j = (ids[known[x]] for x in (pair >> 32, pair & LOW))
            yield batch(pair=(np.maximum(i, j) << 32) | np.minimum(i, j), n=n)

    def name(tables):
        for t in tables:
            pair = t.column("pair").to_numpy()
            i, j, df, rank = pair >> 32, pair & LOW, p.array("df"), p.array("rank")
            i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            yield batch(a=p.names(i), b=p.names(j), n=t.column("n"), df1=df[i], df2=df[j])

    if not p.size:
        return spark.createDataFrame([], "a string, b string, n long, df1 long, df2 long"), p.n
    counted = corpus.select(F.transform("t", lambda x: F.xxhash64(x)).alias("t")).mapInArrow(count, "pair long, n long")
    enough = counted.repartition("pair").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    return enough.mapInArrow(name, "a string, b string, n long, df1 long, df2 long"), p.n


def named(packed: Packed, members: DataFrame) -> DataFrame:
    """(token, root) with names for the ids in token."""

    def run(tables):
        for t in tables:
            yield batch(token=packed.names(t.column("token").to_numpy()), root=t.column("root"))

    return members.select("token", "root").mapInArrow(run, "token string, root long")
