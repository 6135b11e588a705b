"""Signals around a search: colliding query tokens, prediction error, hub damping of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import Damping, damping, surprise
from ..runtime import stored
from .stats import neighbors


def collisions(strengths: DataFrame, joint: DataFrame, strong: float = 0.3, apart: float = 0.15, least: float = 0.1) -> DataFrame:
    """(query_id, a, b, strength_a, strength_b, joint, surprise): pairs of strong tokens of a query that hardly meet, the
    most surprising first.

    strengths: query_id, pos, token, strength (best neighbour's score). joint: t1, t2, score; absent pairs score 0."""
    s = strengths.where(F.col("strength") >= strong)
    one, two = (s.select("query_id", *[F.col(c).alias(f"{c}{k}") for c in ("pos", "token", "strength")]) for k in (1, 2))
    p = one.join(two, "query_id").where((F.col("pos1") < F.col("pos2")) & (F.col("token1") != F.col("token2")))
    p = p.withColumns({"t1": F.least("token1", "token2"), "t2": F.greatest("token1", "token2")}).join(joint.select("t1", "t2", F.col("score").alias("j")), ["t1", "t2"], "left")
    j = F.coalesce("j", F.lit(0.0))
    p = p.select("query_id", F.col("token1").alias("a"), F.col("token2").alias("b"), F.col("strength1").alias("strength_a"), F.col("strength2").alias("strength_b"), j.alias("joint"), surprise(F.col("strength1"), F.col("strength2"), j).alias("surprise"))
    return p.where((F.col("joint") <= apart) & (F.col("surprise") >= least)).orderBy("query_id", F.desc(F.round("surprise", 9)), "a", "b")


def prediction_error(near: DataFrame, queries: DataFrame, ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, predicted, actual, shared, missing, unexpected, error): neighbours of the query's tokens against the
    tokens of the documents it found; error is the Jaccard distance, 0 where both are empty."""
    predicted = queries.select("query_id", F.explode("tokens").alias("token")).join(near, "token").select("query_id", F.col("neighbor").alias("token")).distinct().withColumn("p", F.lit(1))
    actual = ranked.select("query_id", "doc_id").join(docs.select("doc_id", F.explode("tokens").alias("token")), "doc_id").select("query_id", "token").distinct().withColumn("a", F.lit(1))
    g = predicted.join(actual, ["query_id", "token"], "full_outer").groupBy("query_id").agg(F.count("p").alias("predicted"), F.count("a").alias("actual"), F.count(F.when(F.col("p").isNotNull() & F.col("a").isNotNull(), 1)).alias("shared"), F.count(F.lit(1)).alias("u"))
    return g.select("query_id", "predicted", "actual", "shared", (F.col("predicted") - F.col("shared")).alias("missing"), (F.col("actual") - F.col("shared")).alias("unexpected"), (1 - F.col("shared") / F.col("u")).alias("error"))


def token_density(near: DataFrame, queries: DataFrame, vocabulary: DataFrame, d: Damping = Damping(), most: int = 500) -> DataFrame:
    """(query_id, token, neighbors, factor): hub damping of the query's tokens. near: (token, neighbor, score), the best
    first, of which at most 500 a token count; vocabulary: (query_id, size), the distinct tokens of what was found."""
    each = queries.select("query_id", F.explode("tokens").alias("token")).distinct()
    n = near.where(F.col("score") >= d.threshold).groupBy("token").agg(F.least(F.lit(most), F.count(F.lit(1))).alias("neighbors"))
    out = each.join(n, "token", "left").join(vocabulary, "query_id", "left").select("query_id", "token", F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors"), F.coalesce("size", F.lit(0)).alias("size"))
    return out.withColumn("factor", damping(F.when(F.col("size") > 0, F.col("neighbors") / F.greatest(F.col("size"), F.lit(1))).otherwise(0.0), d)).drop("size")


def found_tokens(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, token): the distinct tokens of the documents that a query ranked."""
    return ranked.select("query_id", "doc_id").join(docs.select("doc_id", F.explode("tokens").alias("token")), "doc_id").select("query_id", "token").distinct()


def bundle(queries: DataFrame, ranked: DataFrame, docs: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The three signals of a search. found: scored pairs (t1, t2, n, df1, df2, score); ranked: the top documents."""
    asked = stored(queries.select(F.explode("tokens").alias("token")).distinct())
    near = stored(neighbors(found, 500, only=asked))
    strengths = queries.select("query_id", F.posexplode("tokens").alias("pos", "token")).join(near.where("rank = 1").select("token", F.col("score").alias("strength")), "token")
    size = found_tokens(ranked, docs).groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return {
        "collisions": collisions(strengths, found),
        "prediction_error": prediction_error(near.where("rank <= 10"), queries, ranked, docs),
        "token_damping": token_density(near, queries, size),
    }
