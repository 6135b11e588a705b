"""Substring dedup: repeated-phrase automata.

A repeated passage is a run of words in which every window of MIN_WORDS words (lower-cased, split at white space) is
found in at least two documents. Every occurrence in every document is located:

1. Each window is keyed by its least K-word gram (winnowing: neighbouring windows mostly share it, so a document of n
   words gives about n / 13 keys). Keys of two or more documents stay, on a shelf (shelf.py: hash-sharded sorted arrays
   that executors map into memory).
2. Confirmation: the windows under those keys, as runs with one 64-bit hash a window, meet at their key (equal windows
   have equal keys, so one shuffle settles them). Of windows that a batch holds more than twice, two documents are sent:
   the least and another. A window of two or more documents is recurring, and the smallest (id, place) is where it lives.
   The recurring windows with their homes make a second shelf.
3. Runs of consecutive windows in the documents where they live are the passages. They are sharded by that document, a
   file a shard in the shared folder. Each document asks the second shelf where its windows live and goes to those shards
   and to no other, so work grows with the text and not with text times shards. A task that gets documents of a shard
   makes its passages into an Aho-Corasick automaton (pyahocorasick over word numbers) of SEED-word seeds, at most STRIDE
   words apart and away from the ends: any window of MIN_WORDS words holds a whole seed. The planner may split the
   documents of a shard that many need over several tasks (adaptive rebalancing).
4. A hit is extended to both sides word by word and counts from MIN_WORDS words on.

Nothing is sampled, collected or broadcast, and the steps are the same at every size.

Defined cases. Null ids and null texts are not searched; texts under MIN_WORDS words have no window. Rows of one id
are one document: a passage that only they share isn't repeated; equal rows are reported once. Ties: the smallest id,
then place. A passage that occurs twice in one document and in no other isn't repeated. Empty table: empty result.
Columns of other names aren't read. Windows and documents are told apart by 64-bit hashes.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, mix, read, rolling, session, shared, word_hashes
from .shelf import Shelf, get, keys_only, put, shelve

MIN_WORDS = 50
K = 25
SEED = 8
STRIDE = MIN_WORDS - SEED + 1
#: Passage words of a shard, about.
SHARD_WORDS = 250_000
#: Windows that one step of the confirmation handles.
STEP_WINDOWS = 500_000

def _slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[: len(a) - span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, first window, number of windows, window hashes of all in a row) of the winnowed windows."""
    empty = np.zeros(0, np.uint64)
    flat, sizes = word_hashes(texts)
    n = len(flat)
    if n < MIN_WORDS:
        return empty, empty.astype(np.int64), empty.astype(np.int64), empty.astype(np.int64), empty
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    whole, least = mix(rolling(flat, MIN_WORDS)), _slide_min(mix(rolling(flat, K)), MIN_WORDS - K + 1)
    at = np.flatnonzero(owner[: n - MIN_WORDS + 1] == owner[MIN_WORDS - 1 :])
    if not len(at):
        return empty, empty.astype(np.int64), empty.astype(np.int64), empty.astype(np.int64), empty
    m, who = least[at], owner[at]
    start = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (who[1:] != who[:-1])])
    return m[start], who[start], at[start] - first[who[start]], np.diff(np.r_[start, len(at)]), whole[at]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k (number of the content), c (number of both), t."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("k"), F.xxhash64(F.col(id_col), t).alias("c"), t.alias("t")).where("id is not null and t is not null")


def recurring_keys(rows: DataFrame, kind: str) -> DataFrame:
    """(h): keys of two or more documents."""

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "t"):
                h, who, *_ = keys(texts)
                pair = np.unique(np.column_stack([h, who.astype(np.uint64)]), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].astype(np.uint64).view(np.int64).copy()), table.column("id").take(pa.array(pair[:, 1].astype(np.int64) + start))], names=["h", "id"])

    return rows.select("id", "t").mapInArrow(run, f"h long, id {kind}").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")


def _known(texts, shelf: Shelf):
    """(key, document, first window, number of windows, window hashes) under keys on the shelf."""
    h, who, first, n, ws = keys(texts)
    good = np.zeros(len(h), bool)
    good[shelf.find(h)[0]] = True
    return h[good], who[good], first[good], n[good], ws[np.repeat(good, n)]


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers of the ids in their order."""
    d = ids.dictionary_encode()
    values = d.dictionary.to_pylist()
    rank = np.empty(len(values), np.int64)
    rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    return rank[np.asarray(d.indices)]


def _least_two(h, w, doc, place) -> np.ndarray:
    """Of the windows (h, w): the one of the least (document, place) and the least of another document, if there is one."""
    order = np.lexsort([place, doc, w, h])
    hh, ww, dd = h[order], w[order], doc[order]
    new = np.r_[True, (hh[1:] != hh[:-1]) | (ww[1:] != ww[:-1])]
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    other = dd != dd[start][group]
    second = other & np.r_[True, new[1:] | ~other[:-1]]
    return order[new | second]


def window_rows(rows: DataFrame, kind: str, shelf: Shelf) -> DataFrame:
    """(h, id, c, first, ws): runs of windows under known keys. A batch sends no window of a key for more than two
    documents."""

    def run(tables):
        for table in tables:
            code, c = _codes(table.column("id")), table.column("c")
            for start, texts in batches(table, "t"):
                h, who, first, n, ws = _known(texts, shelf)
                if not len(h):
                    continue
                row = np.repeat(np.arange(len(h)), n)
                place = first[row] + np.arange(len(ws)) - np.repeat(np.cumsum(n) - n, n)
                at = np.sort(_least_two(h[row], ws, code[start + who[row]], place))
                cut_at = np.flatnonzero(np.r_[True, (row[at][1:] != row[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)])
                r = row[at][cut_at]
                take = pa.array(who[r] + start)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[cut_at, len(at)].astype(np.int32)), pa.array(ws[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(h[r].view(np.int64)), table.column("id").take(take), c.take(take), pa.array(place[at][cut_at].astype(np.int32)), lists], names=["h", "id", "c", "first", "ws"])

    return rows.select("id", "c", "t").mapInArrow(run, f"h long, id {kind}, c long, first int, ws array<long>")


def _confirm(step: int):
    """Rows (h, id, c, first, ws) in order become (w, c, at): window w recurs and lives at place at of c."""

    def run(tables):
        # flat windows (key, window, document number, place, content) that aren't settled yet
        held, size, carried, last_id, code = [], 0, 0, None, 0

        def settled(parts, last):
            h, w, doc, place, c = (np.concatenate(x) for x in zip(*parts))
            done = np.ones(len(h), bool) if last else h != h[-1]
            at = _least_two(h[done], w[done], doc[done], place[done])
            at = np.flatnonzero(done)[at]
            twice = np.flatnonzero((h[at][1:] == h[at][:-1]) & (w[at][1:] == w[at][:-1]))
            x = at[twice]  # the first of two documents is the least
            out = pa.RecordBatch.from_arrays([pa.array(w[x].view(np.int64)), pa.array(c[x]), pa.array(place[x])], names=["w", "c", "at"])
            rest = np.flatnonzero(~done)
            rest = rest[_least_two(h[rest], w[rest], doc[rest], place[rest])] if len(rest) else rest
            return out, [tuple(v[rest] for v in (h, w, doc, place, c))]

        for table in tables:
            if not table.num_rows:
                continue
            lists = table.column("ws")
            n = np.asarray(lists.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            # inside a key rows come in the order of the ids: a new id has a higher number than those before
            ids = table.column("id").dictionary_encode()
            index = np.asarray(ids.indices).astype(np.int64)
            change = np.r_[last_id is None or ids.dictionary[int(index[0])].as_py() != last_id, index[1:] != index[:-1]]
            number = code + np.cumsum(change)
            code, last_id = int(number[-1]), ids.dictionary[int(index[-1])].as_py()
            place = np.asarray(table.column("first")).astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            held.append((np.asarray(table.column("h"))[row], np.asarray(lists.flatten()).view(np.uint64), number[row], place, np.asarray(table.column("c"))[row]))
            size += len(row)
            if size >= max(step, 2 * carried):
                out, held = settled(held, False)
                size = carried = len(held[0][0])
                yield out
        if size:
            yield settled(held, True)[0]

    return run


def _found(texts, shelf: Shelf, homes: Shelf):
    """(document, place, home, place there) of each recurring window."""
    h, who, first, n, ws = _known(texts, shelf)
    row = np.repeat(np.arange(len(h)), n)
    place = (first[row] + np.arange(len(ws)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int64)
    x, c, at = homes.find(ws)
    return who[row[x]], place[x], c, at


def _passages(shelf: Shelf, homes: Shelf, dwellings: Shelf, n_shards: int):
    """(shard, id, first, words): the passages that live in the documents (id, c, t)."""

    def run(tables):
        for table in tables:
            own = np.asarray(table.column("c"))
            home = np.zeros(len(own), bool)
            home[dwellings.find(own)[0]] = True
            for start, texts in batches(table, "t"):
                texts = [t if home[start + i] else None for i, t in enumerate(texts)]
                doc, place, c, at = _found(texts, shelf, homes)
                mine = np.flatnonzero((c == own[start + doc]) & (at == place))
                mine = mine[np.lexsort([place[mine], doc[mine]])]
                d, a = doc[mine], place[mine]
                for part in np.split(np.arange(len(d)), np.flatnonzero((np.diff(d) != 0) | (np.diff(a) > 1)) + 1):
                    if len(part):
                        i, j = part[0], part[-1]
                        flat = word_hashes([texts[d[i]]])[0][a[i] : a[j] + MIN_WORDS].view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
                        yield pa.RecordBatch.from_arrays([pa.array([int(own[start + d[i]] % n_shards)], pa.int32()), table.column("id").slice(start + int(d[i]), 1), pa.array([int(a[i])], pa.int32()), lists], names=["shard", "id", "first", "words"])

    return run


def _visits(shelf: Shelf, homes: Shelf, n_shards: int):
    """Documents (id, k, t) become (shard, id, k, t), once for each shard where a window of theirs lives."""

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "t"):
                doc, _, c, _ = _found(texts, shelf, homes)
                if len(doc):
                    # numpy's modulo is never negative
                    to = np.unique(np.column_stack([doc, c % n_shards]), axis=0)
                    take = pa.array(to[:, 0] + start)
                    yield pa.RecordBatch.from_arrays([pa.array(to[:, 1].astype(np.int32)), table.column("id").take(take), table.column("k").take(take), table.column("t").take(take)], names=["shard", "id", "k", "t"])

    return run


def seed_places(n: int) -> list[int]:
    """Where the seeds of a passage of n words begin: every window holds a whole one, and each holds a word that isn't
    only in the outer MIN_WORDS - 1 words, which the passage may share with many others."""
    last = n - MIN_WORDS
    if last < STRIDE:
        return [min(max((n - SEED) // 2, last), STRIDE - 1)]
    return [*range(STRIDE - 1, last, STRIDE), last]


class Shard:
    """The automaton of a shard's passages."""

    def __init__(self):
        self.passages: list[tuple[object, int, np.ndarray]] = []
        self.seen: set[tuple] = set()
        self.automaton = None

    def add(self, id_, first: int, words: np.ndarray) -> None:
        """A passage; equal rows bring it again."""
        key = id_, first, words.tobytes()
        if key not in self.seen:
            self.seen.add(key)
            self.passages.append((id_, first, words))

    def _build(self) -> None:
        seeds: dict[tuple, list[tuple[int, int]]] = {}
        for n, (_, _, w) in enumerate(self.passages):
            short = (w & np.uint64(0x7FFFFFFF)).tolist()
            for o in seed_places(len(w)):
                seeds.setdefault(tuple(short[o : o + SEED]), []).append((n, o))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for s, at in seeds.items():
            self.automaton.add_word(s, at)
        if seeds:
            self.automaton.make_automaton()
        self.empty = not seeds

    def find(self, flat: np.ndarray) -> list[tuple[int, int, object, int]]:
        """(start, end, id and place where it lives) of the maximal common runs with each passage."""
        if self.automaton is None:
            self._build()
        if self.empty or len(flat) < MIN_WORDS:
            return []
        reach: dict[tuple[int, int], int] = {}
        out = []
        for end, hits in self.automaton.iter(tuple((flat & np.uint64(0x7FFFFFFF)).tolist())):
            j = end - SEED + 1
            for n, o in hits:
                if j < reach.get((n, j - o), 0):
                    continue
                id_, first, w = self.passages[n]
                size = min(len(w) - o, len(flat) - j)
                bad = np.flatnonzero(w[o : o + size] != flat[j : j + size])
                right = int(bad[0]) if len(bad) else size
                size = min(o, j)
                bad = np.flatnonzero(w[o - size : o] != flat[j - size : j])
                left = size - 1 - int(bad[-1]) if len(bad) else size
                reach[n, j - o] = j + right
                if left + right >= MIN_WORDS:
                    out.append((j - left, j + right, id_, first + o - left))
        return out


def _written(folder: str):
    """Writes the passages of a shard; returns how many there are."""

    def run(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, t.schema) as out:
            out.write_table(t)
        put(f"{folder}/{t.column('shard')[0].as_py()}.arrow", sink.getvalue().to_pybytes())
        return pa.table({"n": [t.num_rows]})

    return run


def _stream(folder: str):
    """Documents (shard, id, k, t) in order of the shards become (id, k, s, e, first_doc, first_start) of each hit."""

    def run(tables):
        at, shard = None, Shard()
        for table in tables:
            who, found = [], []
            shards = table.column("shard").to_pylist()
            for start, texts in batches(table, "t"):
                flat, sizes = word_hashes(texts)
                end = np.cumsum(sizes)
                for i, to in enumerate(shards[start : start + len(texts)]):
                    if to != at:
                        at, shard = to, Shard()
                        kept = pa.ipc.open_file(pa.BufferReader(get(f"{folder}/{to}.arrow"))).read_all()
                        lists = kept.column("words")
                        for j, (id_, first) in enumerate(zip(kept.column("id").to_pylist(), kept.column("first").to_pylist())):
                            shard.add(id_, first, np.asarray(lists[j].values).view(np.uint64))
                    for hit in shard.find(flat[end[i] - sizes[i] : end[i]]):
                        who.append(start + i)
                        found.append(hit)
            take = pa.array(who, pa.int64())
            ids = table.column("id").take(take)
            cols = [ids, table.column("k").take(take), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], ids.type), pa.array([x[3] for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "k", "s", "e", "first_doc", "first_start"])

    return run


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """id, start_word, n_words of every repeated passage, and first_doc, first_start: where its beginning is found first."""
    session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    shelf = shelve(keys_only(cut(recurring_keys(rows, kind)), "h"))
    met = window_rows(rows, kind, shelf).repartition("h").sortWithinPartitions("h", "id", "c", "first")
    living = cut(met.mapInArrow(_confirm(step_windows), "w long, c long, at long"))
    n_shards = max(1, -(-living.count() // shard_words))
    homes = shelve(keys_only(living, "w", "c", "at"))
    dwellings = shelve(keys_only(cut(living.select("c").distinct()), "c"))
    folder = shared(docs.sparkSession)
    passages = rows.select("id", "c", "t").mapInArrow(_passages(shelf, homes, dwellings, n_shards), f"shard int, id {kind}, first int, words array<long>")
    passages.groupBy("shard").applyInArrow(_written(folder), "n long").agg(F.sum("n")).collect()
    visits = rows.select("id", "k", "t").mapInArrow(_visits(shelf, homes, n_shards), f"shard int, id {kind}, k long, t string")
    hits = visits.hint("rebalance", "shard").sortWithinPartitions("shard").mapInArrow(_stream(folder), f"id {kind}, k long, s int, e int, first_doc {kind}, first_start int")
    # runs that share a window or touch (their windows are neighbours) are one
    listed = hits.groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("s", "e", "first_doc", "first_start"))).alias("x"))

    def merge(tables):
        for table in tables:
            who, out = [], []
            for i, x in enumerate(table.column("x").to_pylist()):
                now = None
                for h in x:
                    if now is not None and h["s"] <= now[1] - MIN_WORDS + 1:
                        now[1] = max(now[1], h["e"])
                    else:
                        now = [h["s"], h["e"], h["first_doc"], h["first_start"]]
                        who.append(i)
                        out.append(now)
            kinds = table.schema.field("x").type.value_type
            yield pa.RecordBatch.from_arrays([table.column("id").take(pa.array(who, pa.int64())), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] - x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], kinds.field("first_doc").type), pa.array([x[3] for x in out], pa.int64())], names=["id", "start_word", "n_words", "first_doc", "first_start"])

    return listed.mapInArrow(merge, f"id {kind}, start_word long, n_words long, first_doc {kind}, first_start long").withColumnRenamed("id", id_col)


SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS pos, hash(array_to_string(ws[i:i + {MIN_WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {MIN_WORDS - 2})) AS i FROM d WHERE len(ws) >= {MIN_WORDS})),
r AS (SELECT h, min({{'doc_id': doc_id, 'pos': pos}}) AS home FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
o AS (SELECT w.doc_id, w.pos, r.home, w.pos - row_number() OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS run FROM w JOIN r USING (h))
SELECT doc_id, min(pos) AS start_word, count(*) + {MIN_WORDS - 1} AS n_words, arg_min(home.doc_id, pos) AS first_doc, arg_min(home.pos, pos) AS first_start
FROM o GROUP BY doc_id, run
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(read(spark, sf_dir, "documents"))
