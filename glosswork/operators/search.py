"""Hybrid search with explanations, one query or many in one plan.

A query is a row (query_id, tokens, wanted tokens, categories). Documents that hold a wanted token are candidates; the
newest four times k of them are scored by association with the query's own tokens, categories, recency, authority and
length. Association needs document pairs of query tokens only: they are counted from the documents that hold one.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import Weights, association, authority, damping, recency, total
from ..functions.text import jaccard
from ..runtime import stored
from .packed import Packed, batch, mask, over, pack_sets, rows, scores, written
from .stats import members


def candidates(docs: DataFrame, queries: DataFrame, limit: int, wanted: str = "wanted") -> DataFrame:
    """(query_id, doc_id, published_at): documents with a wanted token, the newest limit of each query; ties by id.

    A document that is among a query's newest is so for each of its tokens that it holds. So the newest of each token are
    kept first, map side, and only these are joined with the queries: rows don't grow with documents times queries."""
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(wanted)).alias("token")))
    occ = members(docs, "doc_id", "tokens", "published_at").join(asked.select("token").distinct(), "token", "left_semi")
    order = F.desc("published_at"), "doc_id"
    newest = occ.withColumn("r", F.dense_rank().over(Window.partitionBy("token").orderBy(*order))).where(F.col("r") <= limit)
    hits = newest.join(asked, "token").select("query_id", "doc_id", "published_at").distinct()
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= limit).drop("r")


class Indexed(NamedTuple):
    """Documents with their distinct tokens, stored without their texts, and the packed corpus of these."""

    docs: DataFrame
    packed: Packed


def indexed(docs: DataFrame) -> Indexed:
    """docs: doc_id, tokens, cats, published_at, links_out. Tokens are made once, and stored once a document."""
    size, sets = F.size("tokens").alias("size"), F.array_distinct(F.filter("tokens", lambda x: x != "")).alias("tokens")
    kept = stored(docs.select("doc_id", "cats", "published_at", "links_out", size, sets))
    return Indexed(kept, pack_sets(kept, tokens="tokens")[0])


def counted(few: DataFrame, places: DataFrame, queries: DataFrame, found: DataFrame, corpus: Packed, min_df: int, normal: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search needs of the corpus by token ids: asked (query_id, qt, qi), best (query_id, doc_id, qt, best) of the
    query tokens that score above 0 with a document found, and near (qi, near): how many tokens of at least min_df
    documents a query token meets, ten at most.

    few: the documents found, with their place d; places: (doc_id, d). A query token's row of partners is scored where it
    is counted, against the documents that wait for it: no pair leaves the task. One task lays out the tokens of the
    documents found, which are bounded by the queries."""
    each = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("qt"))

    def numbered(tables):
        for t in tables:
            i = corpus.ids(t.column("h").to_numpy())
            # tokens that the corpus doesn't have keep a null id
            yield batch(query_id=t.column("query_id"), qt=t.column("qt"), qi=pa.array(i, mask=i < 0))

    kind = dict(queries.dtypes)["query_id"]
    asked = stored(each.withColumn("h", F.xxhash64("qt")).mapInArrow(numbered, f"query_id {kind}, qt string, qi long"))

    def lists(t):
        """Ids of the tokens of each place, and a mask of them."""
        d, ids = t.column("d").to_numpy(), corpus.ids(t.column("h").to_numpy())
        order = np.argsort(d, kind="stable")
        d, ids = d[order], ids[order]
        new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
        theirs = np.zeros(corpus.size + 1, bool)
        theirs[ids] = True
        return {"held": np.r_[ids, -1], "held_at": np.r_[new, len(d)], "held_d": np.r_[d[new], -1], "theirs": theirs}

    def waits(t):
        """Places that wait for each query token."""
        i, d = t.column("qi").to_numpy(), t.column("d").to_numpy()
        order = np.argsort(i, kind="stable")
        i, d = i[order], d[order]
        new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        return {"wait_i": np.r_[i[new], -1], "wait_at": np.r_[new, len(i)], "wait_d": np.r_[d, -1]}

    with_place = found.select("query_id", "doc_id").join(places, "doc_id")
    tokens = few.select("d", F.explode("tokens").alias("t")).select("d", F.xxhash64("t").alias("h"))
    wanted = asked.where("qi is not null").join(with_place, "query_id").select("qi", "d").distinct()
    at = written(corpus, tokens, lists) | written(corpus, wanted, waits)
    at = {k: v.rpartition("/")[2].removesuffix(".npy") for k, v in at.items()}
    ours = mask(corpus, asked.where("qi is not null").select(F.xxhash64("qt").alias("token")), numbers=True)

    def kernel(p, left, ends, j, n):
        near = np.minimum(over(np.add, (p.array("df")[j] >= min_df).astype(np.int64), ends), 10)
        held, held_at, held_d, theirs, wait_i, wait_at, wait_d = (p.array(at[k]) for k in ("held", "held_at", "held_d", "theirs", "wait_i", "wait_at", "wait_d"))
        qi, place, value, row = [left], [np.full(len(left), -1, np.int64)], [near.astype(np.float64)], np.zeros(p.size)
        for i, a, b in zip(left.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            w = int(np.searchsorted(wait_i[:-1], i))
            x = j[a:b][theirs[j[a:b]]]
            if w + 1 == len(wait_i) or wait_i[w] != i or not len(x):
                continue
            row[x] = scores(p, normal).exact(i, x, n[a:b][theirs[j[a:b]]])
            d = wait_d[wait_at[w] : wait_at[w + 1]]
            d = d[np.isin(d, held_d[:-1])]
            k = np.searchsorted(held_d[:-1], d)
            parts = [row[held[s:e]].max() for s, e in zip(held_at[k].tolist(), held_at[k + 1].tolist())]
            row[x] = 0
            best = np.array(parts, np.float64)
            qi.append(np.full(int((best > 0).sum()), i, np.int64))
            place.append(d[best > 0])
            value.append(best[best > 0])
        place = np.concatenate(place)
        return batch(qi=np.concatenate(qi).astype(np.int64), d=pa.array(place, mask=place < 0), value=np.concatenate(value))

    both = stored(rows(queries.sparkSession, corpus, kernel, "qi long, d long, value double", only=ours))
    best = asked.join(with_place, "query_id").join(both.where("d is not null"), ["qi", "d"]).select("query_id", "doc_id", "qt", F.col("value").alias("best"))
    return asked, best, both.where("d is null").select("qi", F.col("value").cast("long").alias("near"))


def breakdown(docs: DataFrame | Indexed, queries: DataFrame, now: datetime, k: int = 3, weights: Weights = Weights(), normal: bool = True, min_df: int = 5, damped: bool = True) -> DataFrame:
    """query_id, doc_id, published_at, and pmi, cats, recency, authority, length, damping, total of each candidate.

    docs: doc_id, tokens, cats, published_at, links_out, or what indexed() made of them. queries: query_id, tokens,
    wanted, cats."""
    index = docs if isinstance(docs, Indexed) else indexed(docs)
    found = stored(candidates(index.docs, queries, 4 * k))
    places = stored(found.select("doc_id").distinct().withColumn("d", F.monotonically_increasing_id()))
    few = stored(index.docs.join(places, "doc_id"))
    asked, best, near = counted(few, places, queries, found, index.packed, min_df, normal)
    return _scored(found, few.drop("d", "tokens"), queries, asked, best, near, now, weights, damped)


def from_store(store, queries: DataFrame, now: datetime, k: int = 3, weights: Weights = Weights(), normal: bool = True, min_df: int = 5, damped: bool = True) -> DataFrame:
    """breakdown() of a few queries from a store: it reads the postings, frequencies and pairs of their tokens alone, and
    the documents found. The tokens and the ids found go through the driver; both are bounded by the queries."""
    rows = queries.select("tokens", "wanted").collect()
    asked, wanted = (sorted({t for r in rows for t in r[c]}) for c in ("tokens", "wanted"))
    each = queries.select("query_id", F.explode(F.array_distinct("wanted")).alias("token"))
    hits = store.holding(wanted).join(F.broadcast(each), "token").select("query_id", "doc_id", "published_at").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("published_at"), "doc_id")
    found = stored(hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 4 * k).drop("r"))
    all_docs = store.read("docs")
    n = all_docs.count()
    docs = stored(all_docs.where(F.col("doc_id").isin([r["doc_id"] for r in found.select("doc_id").distinct().collect()])).select("doc_id", "tokens", "cats", "published_at", "links_out"))
    own = store.frequencies(asked).select(F.col("token").alias("qt"), F.col("df").alias("df_q"))
    who = stored(queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("qt")).join(own, "qt", "left").select("query_id", "qt", F.when(F.col("df_q").isNotNull(), F.col("qt")).alias("qi"), "df_q"))
    pairs = stored(store.pairs(asked).select(F.col("token").alias("qi"), F.col("neighbor").alias("di"), "n"))
    df = store.read("token_df").select(F.col("token").alias("di"), F.col("df").alias("df_d"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("di"))
    held = found.select("query_id", "doc_id").join(tokens, "doc_id").join(df, "di")
    near = pairs.join(df.where(F.col("df_d") >= min_df), "di", "left_semi").groupBy("qi").agg(F.least(F.lit(10), F.count(F.lit(1))).cast("long").alias("near"))
    score = association(F.col("n"), F.col("df_q"), F.col("df_d"), F.lit(n), normal)
    best = held.join(who, "query_id").join(pairs, ["qi", "di"]).groupBy("query_id", "doc_id", "qt").agg(F.greatest(F.lit(0.0), F.max(score)).alias("best"))
    few = docs.select("doc_id", "cats", "published_at", "links_out", F.size("tokens").alias("size"))
    return _scored(found, few, queries, who, best, near, now, weights, damped)


def _scored(found: DataFrame, docs: DataFrame, queries: DataFrame, asked: DataFrame, best: DataFrame, near: DataFrame, now: datetime, weights: Weights, damped: bool) -> DataFrame:
    """Score parts of the candidates found. docs: the documents found, with the size of their token lists; asked:
    query_id, qt, qi; best: query_id, doc_id, qt, best, above 0; near: qi, near. qi names tokens in any one way."""
    sizes = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    factor = damping(F.coalesce("near", F.lit(0)) / (10.0 * F.col("held"))) if damped else F.lit(1.0)
    factors = asked.join(sizes, "query_id").join(near, "qi", "left").select("query_id", "qt", factor.alias("factor"))
    every = found.select("query_id", "doc_id").join(factors, "query_id").join(best, ["query_id", "doc_id", "qt"], "left")
    parts = every.groupBy("query_id", "doc_id").agg((F.sum(F.coalesce("best", F.lit(0.0)) * F.col("factor")) / F.count(F.lit(1))).alias("pmi"), F.avg("factor").alias("damping"))
    out = found.join(docs.drop("published_at"), "doc_id").join(queries.select("query_id", F.col("cats").alias("__qc")), "query_id").join(parts, ["query_id", "doc_id"], "left")
    age = (F.lit(now.timestamp() * 1e6) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 8.64e10
    out = out.select("query_id", "doc_id", F.coalesce("pmi", F.lit(0.0)).alias("pmi"), jaccard(F.col("__qc"), F.col("cats")).cast("double").alias("cats"), recency(age, weights.scale_days).alias("recency"), authority(F.col("links_out")).alias("authority"), F.ln(F.col("size") + 1.0).alias("length"), F.coalesce("damping", F.lit(1.0)).alias("damping"))
    return out.withColumn("total", total(weights, *(F.col(c) for c in ("pmi", "cats", "recency", "authority", "length"))))


def top_k(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k best documents of each query; ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("total", 6)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_neighbors(docs: DataFrame, queries: DataFrame, near: DataFrame, limit: int = 100, each: int = 5) -> DataFrame:
    """(query_id, doc_id, direct): candidates by the query's tokens, then by each token's nearest neighbours; the first
    way a document is found counts. near: neighbors() with rank."""
    more = queries.select("query_id", F.explode("tokens").alias("token")).join(near.where(F.col("rank") <= each).select("token", "neighbor"), "token").groupBy("query_id").agg(F.collect_set("neighbor").alias("wanted"))
    limit = limit if limit > 0 else 100
    direct = candidates(docs, queries.select("query_id", F.col("tokens").alias("wanted")), limit).withColumn("way", F.lit(0))
    around = candidates(docs, more, limit).withColumn("way", F.lit(1))
    once = direct.union(around).groupBy("query_id", "doc_id", "published_at").agg(F.min("way").alias("way"))
    w = Window.partitionBy("query_id").orderBy("way", F.desc("published_at"), "doc_id")
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select("query_id", "doc_id", (F.col("way") == 0).alias("direct"))


def cards(ranked: DataFrame, docs: DataFrame, queries: DataFrame, id_column: Column) -> DataFrame:
    """One card for each ranked document: title, bullets, sources, score parts, and why it was found (query tokens, those
    that it holds, the query's categories, tokens that facts added). docs: doc_id, title, url, published_at, tokens."""
    q = queries.select("query_id", F.col("tokens").alias("__q"), F.col("cats").alias("__c"), F.array_except("wanted", "tokens").alias("__w"))
    j = ranked.join(docs.select("doc_id", "title", "url", "published_at", F.col("tokens").alias("__t")), "doc_id").join(q, "query_id")
    parts = ("pmi", "cats", "recency", "authority", "length")
    return j.select(
        "query_id",
        "rank",
        "doc_id",
        id_column.alias("id"),
        "title",
        F.array("title").alias("bullets"),
        F.array(F.struct("url", F.col("published_at").alias("time"))).alias("sources"),
        F.create_map(*[v for p in parts for v in (F.lit(p), F.col(p))]).alias("breakdown"),
        F.col("__q").alias("query_tokens"),
        F.array_sort(F.array_intersect("__t", "__q")).alias("matched"),
        F.col("__c").alias("category_overlap"),
        F.col("__w").alias("expanded"),
    )
