"""Queries of the roster over all tokens and pairs against brute force on a small folder."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from glosswork.operators import stats
from glosswork.plans import roster

N = 60


def texts():
    rng = random.Random(8)
    words = [f"w{c}" for c in "abcdefghijkl"]
    return [[*(rng.choice(words) for _ in range(rng.randint(2, 9))), f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}"] for i in range(N)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(i, " ".join(t), "en", "src0", 9) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def counted():
    df, n = Counter(), Counter()
    for t in texts():
        df.update(set(t))
        n.update(combinations(sorted(set(t)), 2))
    return df, n


def npmi(n, a, b):
    return math.log((n + 1) * N / ((a + 1) * (b + 1))) / -math.log((n + 1) / N)


def run(spark, folder, name):
    return [tuple(r) for r in roster.queries()[name](spark, folder).collect()]


def test_every_pair_is_counted(spark, folder):
    df, n = counted()
    by = {}
    for (a, b), k in n.items():
        for t in (a, b):
            by.setdefault(t, []).append(k)
    assert {t: tuple(r) for t, *r in run(spark, folder, "doc_pair_counts")} == {t: (len(v), sum(v), max(v)) for t, v in by.items()}
    got = {(a, b): x for a, b, _, x in run(spark, folder, "npmi_pairs")}
    assert got == pytest.approx({(a, b): npmi(k, df[a], df[b]) for (a, b), k in n.items() if k >= 5}, abs=2e-6)
    c = stats.cut(roster._docs(spark, folder))
    found = stats.pairs(stats.members(c), stats.frequencies(stats.members(c)))
    assert {(r["t1"], r["t2"]): (r["n"], r["df1"], r["df2"]) for r in found.collect()} == {(a, b): (k, df[a], df[b]) for (a, b), k in n.items()}


def test_neighbours_of_every_token_of_five_documents(spark, folder):
    df, n = counted()
    near = {}
    for (a, b), k in n.items():
        if min(df[a], df[b]) >= 5:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, []).append((-round(npmi(k, df[a], df[b]), 9), y))
    got = {}
    for token, y, _, _, rank in sorted(run(spark, folder, "top_neighbors"), key=lambda r: r[4]):
        got.setdefault(token, []).append(y)
    assert max(df.values()) > 0.1 * N and got == {x: [y for _, y in sorted(v)[:10]] for x, v in near.items()}


def test_damping_and_pmi_max_are_over_all_pairs(spark, folder):
    df, n = counted()
    neighbors, scores = Counter(), {}
    for (a, b), k in n.items():
        if npmi(k, df[a], df[b]) >= 0.05:
            neighbors.update((a, b))
    got = {t: (k, f) for t, k, f in run(spark, folder, "damping_factors")}
    assert {t: k for t, (k, _) in got.items()} == {t: neighbors[t] for t in df}
    for (a, b), k in n.items():
        x = npmi(k, df[a], df[b]) * math.sqrt(got[a][1] * got[b][1])
        for t in (a, b):
            scores[t] = max(scores.get(t, 0.0), x)
    assert {r[0]: r[4] for r in run(spark, folder, "stopword_stats")} == pytest.approx(scores, abs=5e-6)


def test_bigrams_and_skipgrams_have_no_floor(spark, folder):
    bi, skip = Counter(), Counter()
    for t in texts():
        bi.update(zip(t, t[1:]))
        skip.update({tuple(sorted((t[i], t[j]))) for i in range(len(t)) for j in range(i + 1, min(len(t), i + 5)) if t[i] != t[j]})
    assert {(a, b): k for a, b, k in run(spark, folder, "bigram_counts")} == dict(bi) and 1 in bi.values()
    assert {(a, b): k for a, b, k in run(spark, folder, "skipgram_counts")} == dict(skip)
    assert {(a, b): k for a, b, k in run(spark, folder, "prune_tokens")} == dict(bi)


def test_tokens_of_very_many_documents_are_split(spark, folder):
    df, n = counted()
    c = stats.coded(stats.cut(roster._docs(spark, folder)))
    words = stats.dictionary(stats.frequencies(stats.members(stats.cut(roster._docs(spark, folder)))))
    name = {r["id"]: r["token"] for r in words.collect()}
    sets = c.select("doc_id", F.array_sort(F.array_distinct("tokens")).alias("v"))
    for least in (1, 4):
        for hot in (7, 1000):
            got = {tuple(sorted((name[r["i"]], name[r["j"]]))): r["n"] for r in stats.array_pairs(sets, words.select(F.col("id").alias("token"), "df"), least, hot).collect()}
            assert got == {k: v for k, v in n.items() if v >= least}
