"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space becomes one blank. An item of m characters has an error budget of
e = floor(RATE * m) edits. Cut into e + 1 pieces, at least one piece of it survives e edits untouched, so every
occurrence within the budget holds some piece exactly. An item under MIN_CHARS characters has no budget: it is one
piece, must stand between word borders, and needs SHORT_WORDS words and SHORT_SEED characters.

The first SEED characters of each piece (SHORT_SEED of a short item) are its seed. The rolling hashes of all places of
all documents are looked up among the seeds, which lie on a shelf (shelf.py: hash-sharded sorted arrays that executors
map into memory), as do the items. Where a seed is hit the whole piece is compared, and the text around it is verified
with Myers' bit-parallel edit distance (approximate substring: ends are free in the document). Documents are read once
whatever the size of the benchmark, and nothing of it is collected or broadcast.

Defined cases. Null or empty documents hit nothing; null and blank items and short ones below the limits match
nothing. Repeated items or rows give repeated results. Ties of distance: the least distance is reported once. Empty
tables: an empty result of pairs, and drop() keeps all documents. Null ids are reported as null by pairs(); drop()
decides by row, not by id. Extra columns of any name pass through drop().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, cut, read, rolling, session, shared, stored
from .shelf import Mapped, Shelf, get, keys_only, local, put, shelve

#: Share of an item's characters that may be inserted, deleted or replaced.
RATE = 0.05
MIN_CHARS = 40
SEED = 12
SHORT_SEED, SHORT_WORDS = 8, 3
#: Items of one file.
ITEMS = 4096

#: Characters hashed at a time.
STEP = 4_000_000
#: Distance of the keys of pieces with one seed.
NEXT = np.uint64(0xD6E8FEB86659FD93)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(m: int, e: int) -> list[tuple[int, int]]:
    """e + 1 (start, end) that cover m characters in about equal parts."""
    cuts = [m * i // (e + 1) for i in range(e + 2)]
    return list(zip(cuts, cuts[1:]))


def plan(text: str, rate: float, min_chars: int) -> tuple[int, list[tuple[int, int]], int] | None:
    """(error budget, pieces, seed length) of a normalised item; None where it can't be searched."""
    if len(text) >= max(min_chars, SEED):
        e = int(rate * len(text))
        # a piece must hold a seed
        e = min(e, len(text) // SEED - 1)
        return e, pieces(len(text), e), SEED
    if len(text) >= SHORT_SEED and text.count(" ") + 1 >= SHORT_WORDS:
        return 0, [(0, len(text))], SHORT_SEED
    return None


def best_end(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """(least edit distance of pattern to a substring of text, the first end of such a substring)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, at = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, at


def within(pattern: str, e: int, text: str, starts: list[int]) -> int | None:
    """The least distance, if at most e, of pattern to the text around the places where it may start."""
    m = len(pattern)
    if e == 0:
        return 0 if any(text.startswith(pattern, s) for s in starts if s >= 0) else None
    spans: list[list[int]] = []
    for s in sorted(starts):  # windows that overlap are one
        if spans and s - e <= spans[-1][1]:
            spans[-1][1] = s + m + e
        else:
            spans.append([s - e, s + m + e])
    if any(text.find(pattern, max(0, a), b) >= 0 for a, b in spans):
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    best = min(best_end(pattern, masks, text[max(0, a) : b])[0] for a, b in spans)
    return best if best <= e else None


def _word(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands between word borders."""
    return (a == 0 or not text[a - 1].isalnum()) and (b >= len(text) or not text[b].isalnum())


class Matcher:
    """The seeds and the items in the shared folder, as a task sees them."""

    def __init__(self, shelf: Shelf, folder: str, rate: float, min_chars: int, seeds: list[int]):
        self.shelf, self.folder, self.rate, self.min_chars, self.seeds = shelf, folder, rate, min_chars, seeds
        self.files = self.known = None

    def _open(self, name: int) -> pa.Table:
        path = f"{self.folder}/{name}.arrow"
        return pa.ipc.open_file(pa.memory_map(local(path)) if local(path) else pa.BufferReader(get(path))).read_all()

    def item(self, n: int):
        """(id, text, (budget, pieces, seed length)) of an item."""
        if self.files is None:
            self.files, self.known = Mapped(self._open), {}
        if n not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            table, row = self.files[n // ITEMS], n % ITEMS
            text = table.column("t")[row].as_py()
            self.known[n] = table.column("id")[row].as_py(), text, plan(text, self.rate, self.min_chars)
        return self.known[n]

    def find(self, texts: list[str | None]) -> list[tuple[int, object, int]]:
        """(number of the text, item id, distance) of the items within their budget."""
        known = [(i, normal(t)) for i, t in enumerate(texts) if t]
        joined = "\n".join(t for _, t in known)
        first = np.cumsum([0] + [len(t) + 1 for _, t in known])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        asked: dict[tuple[int, int], set[int]] = {}
        for size in self.seeds:
            for a in range(0, len(codes), STEP):
                h = seed_hash(codes[a : a + STEP + size - 1], size)
                for x, number, piece in self._hits(h):
                    x += a
                    d = int(np.searchsorted(first, x, "right")) - 1
                    text, place = known[d][1], x - int(first[d])
                    _, item, (_, cuts, seed) = self.item(number)
                    b, c = cuts[piece]
                    if seed == size and text.startswith(item[b:c], place) and (seed == SEED or _word(text, place, place + c - b)):
                        asked.setdefault((d, number), set()).add(place - b)
        out = []
        for (d, number), starts in sorted(asked.items()):
            id_, item, (e, _, _) = self.item(number)
            best = within(item, e, known[d][1], sorted(starts))
            if best is not None:
                out.append((known[d][0], id_, best))
        return out

    def _hits(self, h: np.ndarray):
        """(place in h, item, piece) of all pieces whose seed is hit; the j-th piece of a seed lies under hash + j * NEXT."""
        at, item, packed = self.shelf.find(h)
        more = packed >> 24
        yield from zip(at.tolist(), item.tolist(), (packed & 0xFFFFFF).tolist())
        j = 0
        while len(at := at[more > 1]):
            j, more = j + 1, more[more > 1] - 1
            got, item, packed = self.shelf.find(h[at] + np.array([j], np.uint64) * NEXT)
            yield from zip(at[got].tolist(), item.tolist(), (packed & 0xFFFFFF).tolist())


def seed_hash(codes: np.ndarray, size: int) -> np.ndarray:
    return rolling(codes.astype(np.uint64) + np.uint64(1), size) + np.uint64(size)


def matcher(benchmark: DataFrame, id_col: str, text_col: str, rate: float, min_chars: int) -> Matcher:
    """Writes the items and their seeds to the shared folder."""
    folder = shared(benchmark.sparkSession)

    def write(tables):
        task, files = TaskContext.get().partitionId(), 0
        for table in tables:
            for start in range(0, table.num_rows, ITEMS):
                part = table.slice(start, ITEMS)
                texts = [normal(t) for t in part.column("t").to_pylist()]
                name, files = task << 20 | files, files + 1
                sink = pa.BufferOutputStream()
                rows = pa.record_batch([part.column("id"), pa.array(texts, pa.string())], names=["id", "t"])
                with pa.ipc.new_file(sink, rows.schema) as out:
                    out.write_batch(rows)
                put(f"{folder}/{name}.arrow", sink.getvalue().to_pybytes())
                h, number, piece, size = [], [], [], []
                for k, t in enumerate(texts):
                    if (found := plan(t, rate, min_chars)) is not None:
                        _, cuts, seed = found
                        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                        for p, (a, _) in enumerate(cuts):
                            h.append(seed_hash(codes[a : a + seed], seed)[0])
                            number.append(name * ITEMS + k)
                            piece.append(p)
                            size.append(seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(number, pa.int64()), pa.array(piece, pa.int64()), pa.array(size, pa.int32())], names=["h", "number", "piece", "size"])

    # the rows are stored first: each task reads the same items however often it runs
    items = stored(benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null"))
    seeds = cut(items.mapInArrow(write, "h long, number long, piece long, size int"))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    w = Window.partitionBy("h").orderBy("number", "piece")
    n = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    listed = seeds.join(n, "h").withColumn("j", F.row_number().over(w) - 1)

    def key(tables):
        for t in tables:
            h = np.asarray(t.column("h")).view(np.uint64) + np.asarray(t.column("j")).astype(np.uint64) * NEXT
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), t.column("number"), t.column("v")], names=["h", "a", "b"])

    packed = listed.select("h", "j", "number", (F.col("piece") + F.shiftleft(F.when(F.col("j") == 0, F.col("n")).otherwise(1), 24)).alias("v"))
    return Matcher(shelve(keys_only(cut(packed.mapInArrow(key, "h long, a long, b long")), "h", "a", "b")), folder, rate, min_chars, sizes)


def pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc id, item id, distance) of every item within its budget of some passage of the document."""
    session(docs)
    kind_d, kind_i = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    at = T.StructType([T.StructField("id", kind_d), T.StructField("item", kind_i), T.StructField("distance", T.IntegerType())])
    found, kind = matcher(benchmark, item_col, item_text, rate, min_chars), to_arrow_type(kind_i)

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "t"):
                rows = found.find(texts)
                if rows:
                    yield pa.RecordBatch.from_arrays([table.column("id").take(pa.array([start + r[0] for r in rows])), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int32())], names=["id", "item", "distance"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, at).toDF(id_col, item_col, "distance")


def drop(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, its columns as they are, without the documents that hold a benchmark passage."""
    session(docs)
    found = matcher(benchmark, item_col, item_text, rate, min_chars)

    def run(tables):
        for table in tables:
            clean = np.ones(table.num_rows, bool)
            for start, texts in batches(table, text_col):
                clean[[start + i for i, _, _ in found.find(texts)]] = False
            yield table.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
