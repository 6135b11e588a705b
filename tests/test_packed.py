"""Pairs counted from the packed corpus: equal to brute force on every path, and without a shuffle of pairs."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from glosswork.operators import packed
from glosswork.plans import roster

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]


def texts():
    rng = random.Random(3)
    return [[rng.choice(WORDS[: rng.choice((5, 30, 60))]) for _ in range(rng.randint(0, 25))] for _ in range(80)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("packed")
    rows = [(i, " ".join(t), ("en", "de")[i % 2], "src0", 9) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "waa wab zz"), (2, "wba waa")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def shared():
    df, n = Counter(), Counter()
    for t in texts():
        df.update(set(t))
        n.update(combinations(sorted(set(t)), 2))
    return df, n


@pytest.mark.parametrize("limits", [{}, {"ALONE": 1, "COMMON": 8}, {"ALONE": 1, "PIECE": 3}, {"BATCH": 1}, {"SHARD": 40, "BATCH": 50, "ALONE": 60}])
def test_rows_equal_brute_force(spark, folder, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(packed, k, v)
    df, n = shared()
    p, words = packed.pack(roster._docs(spark, folder))
    assert {r["token"]: r["df"] for r in words.collect()} == df and p.n == 80
    got = [x for b in range(len(p.bounds) - 1) for x in packed._block(p, p.bounds[b], p.bounds[b + 1], packed.supported(2), True, None, 0, None)]
    assert {(a, b): k for x in got for a, b, k in zip(*(x.column(c).to_pylist() for c in ("t1", "t2", "n")))} == {k: v for k, v in n.items() if v >= 2}

    def whole(p, left, ends, j, n):
        return packed.batch(i=p.names(left[packed.each(ends)]), j=p.names(j), n=n)

    names = p.names(packed.np.arange(p.size)).to_pylist()
    assert [-df[x] for x in names] == sorted(-v for v in df.values())
    for head in (0, 7):
        got = Counter()
        for b in range(len(p.bounds) - 1):
            for x in packed._block(p, p.bounds[b], p.bounds[b + 1], whole, False, None, head, None):
                got.update({(a, b): k for a, b, k in zip(*(x.column(c).to_pylist() for c in "ijn"))})
        assert got == {(a, b): k for (x, y), k in n.items() for a, b in ((x, y), (y, x)) if not head or b in names[:head]}


def test_scores(spark, folder):
    df, n = shared()
    p, _ = packed.pack(roster._docs(spark, folder))
    ids = {x: i for i, x in enumerate(p.names(packed.np.arange(p.size)).to_pylist())}
    (a, b), k = n.most_common(1)[0]
    want = math.log((k + 1) * 80 / ((df[a] + 1) * (df[b] + 1))) / -math.log((k + 1) / 80)
    one = lambda x: packed.np.array([x])
    for f in (packed.scores(p), packed.scores(p).exact):
        assert f(one(ids[a]), one(ids[b]), one(k))[0] == pytest.approx(want, abs=1e-12)


def test_a_forest_connects_what_its_edges_connect(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(400)]
    out = [tuple(r) for r in packed.forest(spark.createDataFrame(edges, "a long, b long").coalesce(1), 50).collect()]

    def roots(pairs):
        up = list(range(300))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            up[b] = a
        return [find(x) for x in range(300)]

    assert roots(out) == roots(edges) and len(out) < 300


@pytest.mark.parametrize("name", ["doc_pair_counts", "pmi_pairs", "npmi_pairs", "rule_suggestions", "rule_export", "top_neighbors"])
def test_no_pair_is_shuffled(spark, folder, name):
    plan = roster.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name,most", [("category_histogram", 1), ("reingest_deltas", 0)])
def test_texts_are_tokenized_once(spark, folder, name, most):
    plan = roster.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= most


def test_rounds_equal_sql(spark, folder):
    """Stop words, rounds, factors and phrases of a corpus whose hubs and best partners change from round to round."""
    from .oracle import connect, differences

    con = connect(folder)
    for name in ("stopword_stats", "damping_factors", "autotune_rounds", "phrase_pairs", "clusters", "collisions", "top_neighbors"):
        assert differences(roster.queries()[name](spark, folder), con, roster.SQL[name]) == [], name
