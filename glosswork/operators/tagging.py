"""Categories and entities of documents from a taxonomy, and the phrase parser."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name -> keywords, by kind (sectors, events, regions).
Taxonomy = Mapping[str, Mapping[str, Iterable[str]]]


def keyword_table(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """(category, keyword) over all kinds; a name under several kinds is one category."""
    rows = sorted({(name, k.lower()) for kind in ("sectors", "events", "regions") for name, ks in (taxonomy.get(kind) or {}).items() for k in ks})
    return spark.createDataFrame(rows, "category string, keyword string")


def categories(tokens: Column, taxonomy: Taxonomy) -> Column:
    """Sorted names of which any keyword is one of the tokens."""
    by: dict[str, set[str]] = {}
    for kind in ("sectors", "events", "regions"):
        for name, ks in (taxonomy.get(kind) or {}).items():
            by.setdefault(name, set()).update(k.lower() for k in ks)
    hits = F.array(*[F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, sorted(ks)))), F.lit(name)) for name, ks in sorted(by.items()) if ks]) if any(by.values()) else F.array().cast("array<string>")
    return F.filter(hits, lambda x: x.isNotNull())


def entities(text: Column, kinds: Mapping[str, Mapping[str, Iterable[str]]]) -> Column:
    """array<struct<type, value>>: names of which any keyword is inside the lower-cased text; one hit a name."""
    low = F.lower(text)
    parts = []
    for kind, names in sorted(kinds.items()):
        for name, ks in sorted(names.items()):
            hit = F.lit(False)
            for k in sorted({k.lower() for k in ks}):
                hit = hit | F.contains(low, F.lit(k))
            parts.append(F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(name).alias("value"))))
    if not parts:
        return F.array().cast("array<struct<type:string,value:string>>")
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


#: Tokens that are Python objects at a time, if no document has more.
PIECE = 50_000


def pieces(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with at most PIECE tokens, or of one row."""
    total = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PIECE, "right")))
        yield a, b - a
        a = b


class Phrases:
    """Greedy longest-match phrase parser. entries: (canonical, variants); the last entry for a key counts."""

    def __init__(self, entries: Iterable[tuple[str, Iterable[str]]]):
        self.to: dict[str, str] = {}
        for canonical, variants in entries:
            for key in (canonical, *variants):
                self.to[key.lower()] = canonical
        self.first = {k.split(" ")[0] for k in self.to if " " in k}
        self.longest = max((len(k.split()) for k in self.to), default=1)

    def parse(self, tokens: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(tokens):
            low = tokens[i].lower()
            for n in range(min(self.longest, len(tokens) - i), 1, -1) if low.partition(" ")[0] in self.first else ():
                hit = self.to.get(" ".join(tokens[i : i + n]).lower())
                if hit is not None:
                    break
            else:
                n, hit = 1, self.to.get(low, tokens[i])
            out.append(hit)
            i += n
        return out

    def parsed(self, lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else self.parse(x) for x in lists.to_pylist()], pa.list_(pa.string()))

    def column(self, tokens: Column) -> Column:
        """Over Arrow batches: Spark has no expression that skips ahead inside an array in linear time."""
        sent = self

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for s in parts:
                yield pa.concat_arrays([sent.parsed(s.slice(a, n)) for a, n in pieces(s)] or [pa.array([], pa.list_(pa.string()))])

        return run(tokens) if self.to else tokens


def processed(docs: DataFrame, text: Column, stops: Iterable[str] = (), synonyms: Mapping[str, str] | None = None, phrases: Phrases | None = None, taxonomy: Taxonomy | None = None, kinds: Mapping | None = None) -> DataFrame:
    """docs with tokens, cats, ents: the whole text pipeline. Categories come from phrased tokens, entities from the text."""
    from ..functions.text import tokens

    out = docs.withColumn("tokens", tokens(text, stops, synonyms))
    if phrases is not None:
        out = out.withColumn("tokens", phrases.column(F.col("tokens")))
    return out.withColumns({"cats": categories(F.col("tokens"), taxonomy or {}), "ents": entities(text, kinds or {})})
