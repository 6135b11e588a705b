"""Language identification by interpolated Kneser-Ney character models.

Text becomes a string of symbols: letters lower-cased and folded into 12 bits, runs of everything else one blank. Five
symbols make a 60-bit gram. Grams are counted over every labelled document but each tenth (by a hash of the text), map
side first. From all these counts, none left out, comes one model a language:

  p(w | c) = max(n(cw) - D, 0) / n(c) + D * kinds(c) / n(c) * p(w | shorter c)

with continuation counts below the top order, D = n1 / (n1 + 2 n2) of each order (0.5 where n1 or n2 is 0), and at the
end the uniform share 1 / (A + 1), A being the symbols that the training documents of all languages show.

Counts of grams and contexts of all languages and orders go into the sorted hash arrays of one shelf (shelf.py), sharded
by hash, which executors map into memory; the driver holds the two numbers D comes from for each language and order,
and no gram. A document goes to the language of lowest cross-entropy (bits a symbol). The tenth that was held out gives
each language its threshold: the REJECT_QUANTILE of cross-entropy among its own documents, plus MARGIN bits; above it
the answer is "und".

Defined cases. Null texts and ones without a symbol: "und" with null cross-entropy. Texts of under MIN_SYMBOLS symbols
are never rejected (their cross-entropy scatters). Null labels train nothing. Ties: the first language by name.
Repeated rows count and are answered each. No labelled row: all "und". Empty table: empty result. Columns of other
names aren't read.
"""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, read, session
from .shelf import Shelf, shelve

ORDER = 5
BITS = 12
MASK = (1 << BITS) - 1
MASK_ALL = (1 << BITS * ORDER) - 1
REJECT_QUANTILE = 0.999
MARGIN = 0.25
MIN_SYMBOLS = 40
HELD_OUT = 10
PAD, BLANK = 1, 2
_FLUSH = 3_000_000


def _table() -> np.ndarray:
    """Symbol of each code point of the basic plane; others are letters folded alike."""
    t = np.full(0x10000, BLANK, np.uint16)
    for cp in range(0x10000):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            cp = ord(low) if len(low) == 1 else cp
            t[cp if len(low) != 1 else ord(c)] = cp if 64 < cp <= MASK else 64 + cp * 2654435761 % (MASK - 64)
    return t


_SYMBOL: list[np.ndarray] = []


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each after ORDER - 1 pads; owner of each symbol)."""
    if not _SYMBOL:
        _SYMBOL.append(_table())
    sizes = np.array([len(t or "") for t in texts], np.int64)
    cps = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _SYMBOL[0][np.minimum(cps, 0xFFFF)]
    high = cps > 0xFFFF
    if high.any():
        sym[high] = 64 + cps[high].astype(np.int64) * 2654435761 % (MASK - 64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    # runs of blanks count once, and none at the start of a text
    before = np.r_[True, (sym[:-1] == BLANK) | (owner[1:] != owner[:-1])] if len(sym) else np.zeros(0, bool)
    keep = ~((sym == BLANK) & before)
    sym, owner = sym[keep], owner[keep]
    n = np.bincount(owner, minlength=len(texts))
    pads = ORDER - 1
    at = np.arange(len(sym)) + pads * (owner + 1)
    out = np.full(len(sym) + pads * len(texts), PAD, np.uint16)
    out[at] = sym
    return out, np.repeat(np.arange(len(texts)), n + pads)


def grams(sym: np.ndarray) -> np.ndarray:
    """The gram that ends at each symbol; the first ORDER - 1 are meaningless."""
    g = sym.astype(np.int64)
    out = g.copy()
    for k in range(1, ORDER):
        out[k:] |= g[:-k] << (BITS * k)
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, n) over the documents (lang, t) that aren't held out."""

    def run(tables):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(n, weights=np.concatenate([p[1] for p in parts]), minlength=len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(total)], names=["lang", "g", "n"])
            held.clear()

        for table in tables:
            langs = np.array(table.column("lang").to_pylist(), object)
            for start, texts in batches(table, "t"):
                sym, owner = symbols(texts)
                g, real = grams(sym), sym != PAD
                here = langs[start : start + len(texts)]
                for lang in sorted(set(here)):
                    u, n = np.unique(g[real & (here == lang)[owner]], return_counts=True)
                    held.setdefault(lang, []).append((u, n))
                    size += len(u)
            if size > _FLUSH:
                yield from out()
                size = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, k, key, c), (lang, k, key, total, kinds)) of the grams of k symbols and of their contexts, from the cut
    counts of the top order. A shorter gram counts the kinds of one more symbol before it."""
    suffix = lambda k: F.struct(F.lit(k).alias("k"), F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("key"))
    kinds = counts.select("lang", F.explode(F.array(*map(suffix, range(2, ORDER + 1)))).alias("x")).select("lang", "x.k", "x.key").distinct()
    lower = kinds.select("lang", (F.col("k") - 1).alias("k"), F.expr(f"key & shiftright({MASK_ALL}L, {BITS} * ({ORDER} + 1 - k))").alias("key"))
    grams_ = cut(lower.groupBy("lang", "k", "key").agg(F.count(F.lit(1)).alias("c")).union(counts.select("lang", F.lit(ORDER).alias("k"), "g", "n")))
    return grams_, grams_.groupBy("lang", "k", F.shiftright("key", BITS).alias("key")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))


class Model:
    """Interpolated Kneser-Ney of one language over find(q, tag), which a shelf answers."""

    def __init__(self, lang: str, discounts: dict[int, float], floor: float, shelf: Shelf):
        self.lang, self.d, self.floor, self.shelf = lang, discounts, floor, shelf

    def _p(self, q: np.ndarray, k: int) -> np.ndarray:
        """p of the k-grams q."""
        if k == 0:
            return np.full(len(q), self.floor)
        ctx, back = np.unique(q >> BITS, return_inverse=True)
        total, kinds = np.zeros(len(ctx)), np.zeros(len(ctx))
        at, a, b = self.shelf.find(ctx, f"c{k} {self.lang}")
        total[at], kinds[at] = a, b
        n = np.zeros(len(q))
        known = np.flatnonzero(total[back] > 0)  # a gram's context is there if the gram is
        at, a, _ = self.shelf.find(q[known], f"g{k} {self.lang}")
        n[known[at]] = a
        low, where = np.unique(q & ((1 << BITS * (k - 1)) - 1), return_inverse=True)
        lower = self._p(low, k - 1)[where]
        t = np.maximum(total, 1)[back]
        return np.where(total[back] > 0, (np.maximum(n - self.d[k], 0) + self.d[k] * kinds[back] * lower) / t, lower)

    def bits(self, q: np.ndarray) -> np.ndarray:
        """-log2 p of top-order grams."""
        return -np.log2(self._p(q, ORDER))


class Scorer:
    """Scores grams for all languages; keeps what it has scored in a direct table."""

    def __init__(self, models: list[Model], slots: int = 22):
        self.models, self.shift = models, np.uint64(64 - slots)
        self.slots = slots
        self._reset()

    def _reset(self) -> None:
        self.g, self.v = np.full(1, -1, np.int64), np.zeros((1, len(self.models)), np.float32)
        self.table = np.zeros(1 << self.slots, np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def index(self, g: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(g)]
        miss = np.flatnonzero(self.g[at] != g)
        if len(miss):
            new, back = np.unique(g[miss], return_inverse=True)
            if len(self.g) > 1 and len(self.g) + len(new) > 3_000_000:
                self._reset()
                return self.index(g)
            # grams that share a slot with another are scored again when it is their turn
            base = len(self.g)
            self.g = np.concatenate([self.g, new])
            self.v = np.concatenate([self.v, np.column_stack([m.bits(new) for m in self.models]).astype(np.float32)])
            self.table[self._slot(new)] = np.arange(base, base + len(new))
            at[miss] = base + back
        return at

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits by text and language, symbols by text)."""
        sym, owner = symbols(texts)
        g, real = grams(sym), sym != PAD
        g, owner = g[real], owner[real]
        n = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.models)))
        for a in range(0, len(g), 4_000_000):
            at, who = self.index(g[a : a + 4_000_000]), owner[a : a + 4_000_000]
            for k in range(len(self.models)):
                total[:, k] += np.bincount(who, weights=self.v[:, k][at], minlength=len(texts))
        return total, n


def train(docs: DataFrame) -> tuple[list[str], list[Model]]:
    """Models of all languages among (lang, t)."""
    found, contexts = tables(cut(gram_counts(docs)))
    once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    spread = found.groupBy("lang", "k").agg(once.alias("n1"), twice.alias("n2")).collect()
    if not spread:
        return [], []
    tag = lambda kind: F.concat(F.lit(kind), F.col("k").cast("string"), F.lit(" "), F.col("lang"))
    entries = found.select(tag("g").alias("tag"), "key", F.col("c").alias("a"), F.lit(0).cast("long").alias("b")).union(contexts.select(tag("c"), "key", "total", "kinds"))
    shelf = shelve(cut(entries))
    floor = 1.0 / (found.where("k = 1").select("key").distinct().count() + 1)
    names = sorted({r["lang"] for r in spread})
    d: dict[str, dict[int, float]] = {x: {} for x in names}
    for lang, k, n1, n2 in spread:
        d[lang][k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return names, [Model(x, d[x], floor, shelf) for x in names]


_LOADED: dict[str, Scorer] = {}


def scores(docs: DataFrame, names: list[str], models: list[Model]) -> DataFrame:
    """id, lang, held, best (number), bits a symbol, symbols from (id, lang, held, t)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    def run(tables):
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Scorer(sent.value)
        scorer = _LOADED[key]
        for table in tables:
            for start, texts in batches(table, "t"):
                total, n = scorer(texts)
                h = total / np.maximum(n, 1)[:, None]
                best = h.argmin(1)
                part = table.slice(start, len(texts))
                none = n == 0
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), part.column("held"), pa.array(best.astype(np.int32), mask=none), pa.array(h[np.arange(len(h)), best], mask=none), pa.array(n.astype(np.int64))], names=["id", "lang", "held", "best", "bits", "symbols"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, lang string, held boolean, best int, bits double, symbols long")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = REJECT_QUANTILE, margin: float = MARGIN) -> DataFrame:
    """id, language, best (before rejection), bits (cross-entropy a symbol), symbols of every row."""
    session(docs)
    held = F.pmod(F.xxhash64(F.lit("held"), F.col(text_col)), F.lit(HELD_OUT)) == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), held.alias("held"), F.col(text_col).alias("t"))
    names, models = train(rows.where("lang is not null and t is not null and not held").select("lang", "t"))
    if not names:
        none = F.lit(None)
        return docs.select(F.col(id_col), F.lit("und").alias("language"), none.cast("string").alias("best"), none.cast("double").alias("bits"), F.lit(0).cast("long").alias("symbols"))
    got = cut(scores(rows, names, models))
    # under ANSI mode element_at takes its index for not null
    name = F.when(F.col("best").isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.col("best") + 1))
    got = got.withColumn("name", name)
    own = got.where((F.col("name") == F.col("lang")) & (F.col("symbols") >= MIN_SYMBOLS))
    limits = {x: (q + margin) for x, q in own.where("held").groupBy("name").agg(F.percentile_approx("bits", quantile, 10_000).alias("q")).collect()}
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for x in names for v in (x, float(limits.get(x, 1e9)))]), F.col("name")), F.lit(1e9))
    ok = F.col("name").isNotNull() & ((F.col("bits") <= limit) | (F.col("symbols") < MIN_SYMBOLS))
    return got.select(F.col("id").alias(id_col), F.when(ok, F.col("name")).otherwise("und").alias("language"), F.col("name").alias("best"), F.round("bits", 6).alias("bits"), "symbols")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
