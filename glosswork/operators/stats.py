"""Corpus statistics: documents, document frequencies, pairs, bigrams, skip-grams, and what is scored from them.

A corpus is a frame with a key column and an ordered array column of tokens. Repeated tokens count once a document but
for bigrams. Nothing is collected; only N, a number, is read by the driver where a plan needs it as a literal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import Damping, association, damped_pair, damping
from ..runtime import cut, stored


def members(corpus: DataFrame, key: str = "doc_id", tokens: str = "tokens", *more: str) -> DataFrame:
    """(key, token, *more), each token once a document; narrow. Tokens may be numbers, see coded()."""
    out = corpus.select(F.col(key).alias("doc_id"), *more, F.explode(F.array_distinct(F.col(tokens))).alias("token"))
    return out.where("token <> ''") if dict(out.dtypes)["token"] == "string" else out


def number(token: Column) -> Column:
    """The 64-bit number that stands for a token while pairs are counted."""
    return F.xxhash64(token)


def coded(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The corpus with numbers for its tokens, made inside each row; dictionary() leads back."""
    return corpus.withColumn(tokens, F.transform(F.filter(tokens, lambda x: x != ""), number))


def dictionary(df: DataFrame) -> DataFrame:
    """(token, df, id) from frequencies(), stored. Two tokens of one number, which 64 bits make all but impossible, are
    an error: no count is ever mixed up."""
    out = stored(df.select("token", "df", number(F.col("token")).alias("id")))
    if not out.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("two tokens have one number")
    return out


def named(counts: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    """Numbers in the columns become tokens again; words: dictionary()."""
    for c in columns:
        w = words.select(F.col("id").alias("__id"), F.col("token").alias("__token"))
        counts = counts.join(w, F.col(c) == F.col("__id")).drop(c, "__id").withColumnRenamed("__token", c)
    return counts


def frequencies(occ: DataFrame) -> DataFrame:
    """(token, df) from members()."""
    return occ.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def frequency_stats(df: DataFrame, n: int, *more: str) -> DataFrame:
    """token, df, df_percent, idf, *more."""
    return df.select("token", "df", (F.lit(100.0) * F.col("df") / n).alias("df_percent"), F.ln(F.lit(float(n)) / (1 + F.col("df"))).alias("idf"), *more)


def band(df: DataFrame, n: int, least: float = 0.0, most: float = 1.0, floor: int = 1) -> DataFrame:
    """Tokens in at least floor and a share least of the documents, and at most a share most."""
    return df.where((F.col("df") >= floor) & (F.col("df") >= least * n) & (F.col("df") <= most * n))


#: Documents of a token that one task handles; a token of more is split by document and its counts are added up.
HOT = 100_000


def array_pairs(sets: DataFrame, df: DataFrame, least: int = 1, hot: int = HOT) -> DataFrame:
    """(i, j, n): documents that hold both numbers, i < j, if at least least do. sets: doc_id and an array v of distinct
    numbers in order; df: (token, df) of the numbers.

    A row of the generator is a left number with those after it, so no row holds more than one document's. The rows of a
    left number meet in one task as whole arrays, not pair by pair, and are counted there by sorting, group after group;
    only counts that reach the support leave it."""
    spark = sets.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    left = sets.select("doc_id", "v", F.posexplode("v").alias("p", "i")).where(F.col("p") + 1 < F.size("v")).select("doc_id", "i", F.slice("v", F.col("p") + 2, F.size("v")).alias("rest"))
    # few tokens can be so frequent: each takes hot of the occurrences there are
    many = stored(df.where(F.col("df") > hot).select(F.col("token").alias("__t"), F.ceil(F.col("df") / hot).cast("int").alias("__parts")))
    split = not many.isEmpty()
    if split:
        left = left.join(F.broadcast(many), F.col("i") == F.col("__t"), "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("__parts", F.lit(1))).cast("int")).withColumn("whole", F.col("__parts").isNull())
    else:
        left = left.withColumns({"part": F.lit(0), "whole": F.lit(True)})

    def count(tables):
        at, held, size = None, [], 0

        def summed():
            if len(held) > 1 or held[0][1] is None:
                j = np.concatenate([x for x, _ in held])
                k = np.concatenate([np.ones(len(x), np.int64) if n is None else n for x, n in held])
                if all(n is None for _, n in held):
                    u, c = np.unique(j, return_counts=True)
                else:
                    u, back = np.unique(j, return_inverse=True)
                    c = np.bincount(back, weights=k, minlength=len(u)).astype(np.int64)
                held[:] = [(u, c)]
            return held[0]

        done: list[tuple] = []
        for t in tables:
            lists = t.column("rest")
            i, part, whole = np.asarray(t.column("i")), np.asarray(t.column("part")), t.column("whole").to_numpy(zero_copy_only=False)
            flat, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
            new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (part[1:] != part[:-1])]) if len(i) else []
            for a, b in zip(new, [*new[1:], len(i)]):
                here = i[a], part[a], whole[a]
                if here != at:
                    if at is not None:
                        done.append((at, *summed()))
                    at, held, size = here, [], 0
                held.append((flat[ends[a - 1] if a else 0 : ends[b - 1]], None))
                size += len(held[-1][0])
                if size > 4_000_000:
                    size = len(summed()[0])
            yield from _counted(done, least)
            done = []
        if at is not None:
            yield from _counted([(at, *summed())], least)

    met = left.select("i", "part", "whole", "rest").repartition("i", "part").sortWithinPartitions("i", "part")
    out = met.mapInArrow(count, "i long, j long, n long")
    return out.groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= least) if split else out


def _counted(done: list[tuple], least: int):
    """One batch of the counts of whole left numbers that reach the support, and of all counts of split ones."""
    kept = [(i, j[n >= least], n[n >= least]) if whole and least > 1 else (i, j, n) for (i, _, whole), j, n in done]
    if kept:
        i = np.repeat(np.array([x for x, _, _ in kept], np.int64), [len(j) for _, j, _ in kept])
        j, n = (np.concatenate([x[k] for x in kept]).astype(np.int64) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n)], names=["i", "j", "n"])


def pairs(occ: DataFrame, df: DataFrame, n_least: int = 1) -> DataFrame:
    """(t1, t2, n, df1, df2), t1 < t2, of the tokens in df that n_least documents share.

    Only a token in n_least documents can have such a pair. Counting is done with numbers; names come to what is left."""
    words = dictionary(df.where(F.col("df") >= n_least))
    ids = occ.select("doc_id", number(F.col("token")).alias("id")).join(words.select("id"), "id", "left_semi")
    side = lambda k: words.select(F.col("id").alias("ij"[k - 1]), F.col("token").alias(f"x{k}"), F.col("df").alias(f"d{k}"))
    sets = ids.groupBy("doc_id").agg(F.array_sort(F.collect_list("id")).alias("v"))
    found = array_pairs(sets, words.select(F.col("id").alias("token"), "df"), n_least).join(side(1), "i").join(side(2), "j")
    up = F.col("x1") < F.col("x2")
    return found.select(F.when(up, F.col("x1")).otherwise(F.col("x2")).alias("t1"), F.when(up, F.col("x2")).otherwise(F.col("x1")).alias("t2"), "n", F.when(up, F.col("d1")).otherwise(F.col("d2")).alias("df1"), F.when(up, F.col("d2")).otherwise(F.col("d1")).alias("df2"))


def all_pairs(corpus: DataFrame, df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(t1, t2, n, df1, df2) of all pairs of a coded() corpus; df: (token, df) of its numbers, stored."""
    found = array_pairs(corpus.select("doc_id", F.array_sort(F.array_distinct(tokens)).alias("v")), df)
    side = lambda k: df.select(F.col("token").alias(f"t{k}"), F.col("df").alias(f"df{k}"))
    return found.select(F.col("i").alias("t1"), F.col("j").alias("t2"), "n").join(side(1), "t1").join(side(2), "t2").select("t1", "t2", "n", "df1", "df2")


def scored(found: DataFrame, n: int, normal: bool = True) -> DataFrame:
    """pairs() with a score."""
    return found.withColumn("score", association(F.col("n"), F.col("df1"), F.col("df2"), F.lit(n), normal))


def both_ways(found: DataFrame) -> DataFrame:
    """(token, neighbor, n, token_df, neighbor_df, score): each pair from either end, in one pass."""
    one = F.struct(F.col("t1").alias("token"), F.col("t2").alias("neighbor"), F.col("df1").alias("token_df"), F.col("df2").alias("neighbor_df"))
    two = F.struct(F.col("t2").alias("token"), F.col("t1").alias("neighbor"), F.col("df2").alias("token_df"), F.col("df1").alias("neighbor_df"))
    return found.select(F.explode(F.array(one, two)).alias("x"), "n", "score").select("x.*", "n", "score")


def neighbors(found: DataFrame, k: int = 10, min_df: int = 5, only: DataFrame | None = None) -> DataFrame:
    """The k best-scored neighbours of each token, or of those in only (token); ties by name. k of 0 or less means 10."""
    from pyspark.sql import Window

    w = Window.partitionBy("token").orderBy(F.desc(F.round("score", 9)), "neighbor")
    near = both_ways(found).where((F.col("neighbor_df") >= min_df) & (F.col("token_df") >= min_df))
    if only is not None:
        near = near.join(only.select(F.col("token").alias("__t")), F.col("token") == F.col("__t"), "left_semi")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (k if k > 0 else 10)).select("token", "neighbor", "n", "score", "rank")


def damping_factors(found: DataFrame, df: DataFrame, size: int, d: Damping = Damping()) -> DataFrame:
    """(token, neighbors, factor) of every token of df; size: tokens of the vocabulary. Neighbours score at least the threshold."""
    near = ends(found.where(F.col("score") >= d.threshold), lambda t: [F.count(F.lit(1)).alias("neighbors")], lambda: [F.sum("neighbors").alias("neighbors")])
    ratio = F.col("neighbors") / float(size) if size else F.lit(0.0)
    return df.select("token").join(near, "token", "left").select("token", F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors")).withColumn("factor", damping(ratio, d))


def damped(found: DataFrame, factors: DataFrame) -> DataFrame:
    """scored() pairs with the score damped at both ends; factors should be stored."""
    one, two = (factors.select(F.col("token").alias(f"t{k}"), F.col("factor").alias(f"f{k}")) for k in (1, 2))
    return found.join(one, "t1").join(two, "t2").withColumn("score", damped_pair(F.col("score"), F.col("f1"), F.col("f2"))).drop("f1", "f2")


def best_scores(found: DataFrame) -> DataFrame:
    """(token, pmi_max): the highest damped score of a token's pairs, 0 at least."""
    return ends(found, lambda t: [F.max("score").alias("m")], lambda: [F.greatest(F.lit(0.0), F.max("m")).alias("pmi_max")])


def ends(found: DataFrame, first, second) -> DataFrame:
    """An aggregate of each token's pairs: by the left ends, by the right ends, and of both; no pair is doubled."""
    one, two = (found.groupBy(F.col(t).alias("token")).agg(*first(t)) for t in ("t1", "t2"))
    return one.union(two).groupBy("token").agg(*second())


#: Tokens of a piece whose adjacent pairs are counted at once in a task.
NEAR = 2_000_000
LOW = (1 << 32) - 1


def bigrams(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(a, b, n): adjacent tokens, every occurrence, order kept."""
    return _near(corpus, tokens, 2, True)


def skipgrams(corpus: DataFrame, tokens: str = "tokens", window: int = 5) -> DataFrame:
    """(a, b, n), a < b: documents in which both stand fewer than window places apart. A window under 2 means 2."""
    return _near(corpus, tokens, max(2, window), False)


def _near(corpus: DataFrame, tokens: str, window: int, ordered: bool) -> DataFrame:
    """(a, b, n) of tokens fewer than window places apart; ordered: every occurrence as it stands, else documents of
    a < b. A task counts piece by piece, so its memory is bounded, and the only shuffle is of these counts."""
    kind = dict(corpus.dtypes)[tokens].removeprefix("array<").removesuffix(">")
    corpus.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))

    def run(tables):
        for held in near_pieces(tables):
            yield from _near_counts(held, window, ordered)

    counted = corpus.select(F.col(tokens).alias("t")).mapInArrow(run, f"a {kind}, b {kind}, n long")
    # the counts of a piece hardly meet again before the shuffle
    return counted.repartition("a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def near_pieces(tables):
    """Lists of the arrays t of the tables, of NEAR tokens each and at most one document more."""
    held, size = [], 0
    for t in tables:
        lists = t.column("t")
        total = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))
        a = 0
        while a < len(lists):
            before = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, before + NEAR - size, "right")))
            held.append(lists.slice(a, b - a))
            size += int(total[b - 1] - before)
            a = b
            if size >= NEAR or a < len(lists):
                yield held
                held, size = [], 0
    if held:
        yield held


def _near_counts(held: list[pa.Array], window: int, ordered: bool):
    """Batches (a, b, n) of the documents of a piece."""
    code, doc, names = near_codes(held)
    if len(code) < 2:
        return
    if not ordered:
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code, names = rank[code], names.take(pa.array(order))
    pair = near_pairs(code, doc, window, ordered)
    pair, n = np.unique(pair, return_counts=True)
    i, j = pair >> 32, pair & LOW
    for at in range(0, len(pair), 200_000):
        a, b = (names.take(pa.array(x[at : at + 200_000])) for x in (i, j))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(n[at : at + 200_000])], names=["a", "b", "n"])


def near_codes(held: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each token, number of its document, tokens by code)."""
    coded = pa.chunked_array([x.flatten() for x in held]).combine_chunks().dictionary_encode()
    sizes = np.concatenate([np.asarray(x.value_lengths().fill_null(0)) for x in held])
    return coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), coded.dictionary


def near_pairs(code: np.ndarray, doc: np.ndarray, window: int, ordered: bool) -> np.ndarray:
    """i << 32 | j of the codes fewer than window places apart, without codes under 0; if not ordered i < j, once a
    document."""
    found, of = [], []
    for k in range(1, min(window, len(code))):
        x, y = code[:-k], code[k:]
        keep = (doc[:-k] == doc[k:]) & (x >= 0) & (y >= 0)
        if not ordered:
            keep &= x != y
        x, y = x[keep], y[keep]
        found.append((x << 32) | y if ordered else (np.minimum(x, y) << 32) | np.maximum(x, y))
        of.append(doc[:-k][keep])
    if not found:
        return np.zeros(0, np.int64)
    pair = np.concatenate(found)
    if ordered or not len(pair):
        return pair
    of, bits = np.concatenate(of), int(code.max()).bit_length()
    if 2 * bits + int(of.max()).bit_length() < 64:  # one number for all three sorts fastest
        key = np.sort((of << 2 * bits) | (pair >> 32 << bits) | (pair & LOW))
        key = key[np.r_[True, key[1:] != key[:-1]]] & ((1 << 2 * bits) - 1)
        return (key >> bits << 32) | (key & ((1 << bits) - 1))
    order = np.lexsort((of, pair))
    pair, of = pair[order], of[order]
    return pair[np.r_[True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])]]


def token_categories(corpus: DataFrame, cats: Column, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(token, category, n): once a document; a category that the document lists twice counts twice."""
    each = corpus.withColumn("category", F.explode(cats))
    return members(each, key, tokens, "category").groupBy("token", "category").agg(F.count(F.lit(1)).alias("n"))


def entropies(token_cats: DataFrame) -> DataFrame:
    """(token, entropy): base 2 over the categories, divided by log2(kinds + 1)."""
    total = token_cats.groupBy("token").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log2("n")).alias("x"), F.count(F.lit(1)).alias("k"))
    return total.select("token", ((F.log2("s") - F.col("x") / F.col("s")) / F.log2(F.col("k") + 1.0)).alias("entropy"))


def main_category(token_cats: DataFrame) -> DataFrame:
    """(token, category): the most frequent one; ties by name."""
    return token_cats.groupBy("token").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))


def phrase_pairs(found_bigrams: DataFrame, found: DataFrame, min_score: float, limit: int) -> DataFrame:
    """Bigrams whose pair scores enough, by phrase score (bigram count times damped score); found is scored and damped.

    Both sides name tokens alike, by name or by number; ties are broken by a and b."""
    b = found_bigrams.where("a <> b").withColumns({"t1": F.least("a", "b"), "t2": F.greatest("a", "b")})
    out = b.withColumnRenamed("n", "bigrams").join(found.withColumnRenamed("n", "support"), ["t1", "t2"]).where(F.col("score") >= min_score)
    return out.select("a", "b", "score", "bigrams", "support", (F.col("bigrams") * F.col("score")).alias("phrase_score")).orderBy(F.desc(F.round("phrase_score", 6)), F.desc("bigrams"), "a", "b").limit(limit)


def supported_phrases(found_bigrams: DataFrame, found: DataFrame, min_score: float, support: int, limit: int) -> DataFrame:
    """The best 2 * limit phrase pairs, of these the ones of enough support, of these the best limit: in that order."""
    order = (F.desc(F.round("phrase_score", 6)), F.desc("bigrams"), "a", "b")
    return phrase_pairs(found_bigrams, found, min_score, 2 * limit).where(F.col("support") >= support).orderBy(*order).limit(limit)


def linked_tokens(skips: DataFrame, df: DataFrame, n: int, min_support: int, normal: bool = True, ordered: bool = False) -> DataFrame:
    """Skip-gram pairs of enough support with their score (contextual neighbours); ordered: the best first."""
    one, two = (df.select(F.col("token").alias(c), F.col("df").alias(f"df{k}")) for k, c in ((1, "a"), (2, "b")))
    out = skips.where(F.col("n") >= min_support).join(one, "a").join(two, "b").select("a", "b", "n", association(F.col("n"), F.col("df1"), F.col("df2"), F.lit(n), normal).alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), F.desc("n"), "a", "b") if ordered else out


def without_tokens(stats: DataFrame, tokens: DataFrame, *columns: str) -> DataFrame:
    """A table of counts without the rows that name one of the tokens; what else there is stays as counted."""
    gone = stored(tokens.select(F.col("token").alias("__gone")).distinct())
    for c in columns:
        stats = stats.join(gone, F.col(c) == F.col("__gone"), "left_anti")
    return stats
