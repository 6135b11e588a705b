from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glosswork.operators import bootstrap, signals, stats, tuning


def corpus(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")


def table(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def pairs_of(spark, docs):
    occ = stats.members(corpus(spark, docs))
    return {(r["t1"], r["t2"]): r["n"] for r in stats.pairs(occ, stats.frequencies(occ)).collect()}


def test_bigrams_and_pairs(spark):
    d = "deep learning models use deep neural networks".split()
    assert set(table(stats.bigrams(corpus(spark, [d]))).values()) == {1} and stats.bigrams(corpus(spark, [d])).count() == 6
    found = pairs_of(spark, [d])
    assert found["deep", "learning"] == 1 and len(found) == 15


def test_skipgram_window(spark):
    got = set(table(stats.skipgrams(corpus(spark, [list("abcde")]), window=3)))
    assert got == {tuple(x) for x in "ab ac bc bd cd ce de".split()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "ee"]), max_size=9), min_size=1, max_size=6))
def test_counts_equal_brute_force(spark, docs):
    df, pair, bi, skip = Counter(), Counter(), Counter(), Counter()
    for d in docs:
        df.update(set(d))
        pair.update(combinations(sorted(set(d)), 2))
        bi.update(zip(d, d[1:]))
        skip.update({tuple(sorted((d[i], d[j]))) for i in range(len(d)) for j in range(i + 1, min(len(d), i + 5)) if d[i] != d[j]})
    c = corpus(spark, docs)
    assert table(stats.frequencies(stats.members(c))) == {(k,): v for k, v in df.items()}
    assert pairs_of(spark, docs) == dict(pair)
    assert table(stats.bigrams(c)) == dict(bi)
    assert table(stats.skipgrams(c)) == dict(skip)
    assert all(n <= min(df[a], df[b]) <= len(docs) for (a, b), n in pair.items())


def test_hub_is_damped_and_the_rare_pair_is_not(spark):
    docs = [["hub", f"p{i}"] for i in range(20)] + [["rare-a", "rare-b"]] * 10 + [[f"x{i}"] for i in range(10)]
    occ = stats.members(corpus(spark, docs))
    df = stats.cut(stats.frequencies(occ))
    found = stats.scored(stats.pairs(occ, df), len(docs), False)
    f = {r["token"]: r["factor"] for r in stats.damping_factors(found, df, df.count()).collect()}
    assert f["hub"] < 1 and f["rare-a"] == 1


def test_entropy_and_main_category(spark):
    tc = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "x", 3)], "token string, category string, n long")
    e = {r["token"]: r["entropy"] for r in stats.entropies(tc).collect()}
    assert e["a"] == pytest.approx(0.6309, abs=1e-4) and e["b"] == pytest.approx(0)
    assert {r["token"]: r["category"] for r in stats.main_category(tc).collect()} == {"a": "x", "b": "x"}


def test_neighbors_rank_and_default_k(spark):
    occ = stats.members(corpus(spark, [["machine", "learning"]] * 8 + [["machine", "deep"]] * 5 + [["other"]] * 7))
    found = stats.scored(stats.pairs(occ, stats.frequencies(occ)), 20)
    got = [r["neighbor"] for r in stats.neighbors(found, 0).where("token = 'machine'").orderBy("rank").collect()]
    assert got == ["learning", "deep"]


def test_drift(spark):
    docs = [["machine", "learning"]] * 10 + [["deep", "neural"]] * 10
    df = stats.frequencies(stats.members(corpus(spark, docs)))
    kw = spark.createDataFrame([("ai", "machine"), ("ai", "obsolete")], "category string, keyword string")
    none = spark.createDataFrame([], "token string, category string, n long")
    stops = spark.createDataFrame([("neural",)], "token string")
    out = {(r["kind"], r["token"]): r for r in tuning.drift(df, 20, kw, stops, none).collect()}
    assert out["low_coverage", "obsolete"]["share"] == 0 and ("low_coverage", "machine") not in out
    assert {t for k, t in out if k == "orphan"} == {"learning", "deep"}


def test_rounds_find_the_common_word_and_stop(spark):
    docs = [["the", f"w{i}", f"v{i}"] for i in range(10)]
    t = tuning.StopThresholds(entropy=-1.0)
    found, done = tuning.rounds(corpus(spark, docs), t, 3)
    assert [(r["round"], r["token"]) for r in found.collect()] == [(1, "the")] and done == 2
    _, report = bootstrap.run(corpus(spark, docs), ["base"], 3, t)
    assert [r["new_stopwords"] for r in report] == [["the"], []] and report[-1]["total_stopwords"] == 2
    now, report = bootstrap.run(corpus(spark, docs), [], 0, t)
    assert now is None and report == []
    now, _ = bootstrap.run(corpus(spark, [["aa", "the", "bb"]] * 9 + [["cc"]]), [], 2, t)
    assert ("aa", "bb") in table(stats.bigrams(now)) or "aa" not in {x for r in now.collect() for x in r["tokens"]}


def test_reviewer_and_prune(spark):
    found, _ = tuning.rounds(corpus(spark, [["the", f"w{i}"] for i in range(10)]), tuning.StopThresholds(entropy=-1.0), 3, reviewer=lambda rows: [])
    assert found.count() == 0
    gone = spark.createDataFrame([("b",)], "token string")
    left = stats.without_tokens(stats.bigrams(corpus(spark, [list("abcd")])), gone, "a", "b")
    assert set(table(left)) == {("c", "d")}


def test_collision_and_prediction_error(spark):
    s = spark.createDataFrame([(1, 0, "perovskite", 2.0), (1, 1, "finance", 1.8), (1, 2, "weak", 0.1)], "query_id long, pos int, token string, strength double")
    j = spark.createDataFrame([("finance", "perovskite", 0.05)], "t1 string, t2 string, score double")
    out = signals.collisions(s, j).collect()
    assert len(out) == 1 and out[0]["surprise"] == pytest.approx(0.898683, abs=1e-6)
    near = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.01)], "token string, neighbor string, score double")
    q = spark.createDataFrame([(1, ["q"])], "query_id long, tokens array<string>")
    docs = spark.createDataFrame([(7, ["a", "c"])], "doc_id long, tokens array<string>")
    r = signals.prediction_error(near, q, spark.createDataFrame([(1, 7)], "query_id long, doc_id long"), docs).first()
    assert (r["shared"], r["missing"], r["unexpected"]) == (1, 1, 1) and r["error"] == pytest.approx(2 / 3)
    d = signals.token_density(near, q, spark.createDataFrame([(1, 2)], "query_id long, size long")).first()
    assert d["neighbors"] == 1 and d["factor"] == pytest.approx(1 - (2 / 3) ** 2 * (3 - 4 / 3) * 0.9)


def test_support_is_asked_between_two_limits(spark):
    bi = spark.createDataFrame([("a", "b", 9), ("c", "d", 8), ("e", "f", 7), ("g", "h", 6)], "a string, b string, n long")
    found = spark.createDataFrame([("a", "b", 1, 1.0), ("c", "d", 5, 1.0), ("e", "f", 5, 1.0), ("g", "h", 5, 1.0)], "t1 string, t2 string, n long, score double")
    assert [r["a"] for r in stats.supported_phrases(bi, found, 0.1, 3, 1).collect()] == ["c"]
    assert [r["a"] for r in stats.supported_phrases(bi, found, 0.1, 3, 2).collect()] == ["c", "e"]


def test_keywords_and_taxonomy(spark):
    df = spark.createDataFrame([("solar", 10), ("new", 10), ("ab", 10), ("a1234", 10), ("everywhere", 90), ("rare", 1), ("a-b-c-d", 10)], "token string, df long")
    assert [r["token"] for r in bootstrap.keywords(df, 100).collect()] == ["solar"]
    p = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert bootstrap.taxonomy(p, df) == {"domain-1": ["a", "b", "c"]}
    assert bootstrap.taxonomy(p.limit(0), df.limit(0)) == {"domain-fallback": ["general"]}
    assert bootstrap.topics_of({"x": ["a"], "y": ["a", "b"]}, "a", "b") == "y" and bootstrap.topics_of({}, "a", "b") == ""
