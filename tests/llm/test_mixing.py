import numpy as np
import pytest
from glosswork.llm import mixing

from .frames import DOCS, LABELS, clashing, frame, odd, rows

T = {"en": 0.5, "de": 0.3, "fr": 0.2}


def labels(spark, data, every=2):
    return spark.createDataFrame([(r[0], 1, 0) for k, r in enumerate(data) if k % every == 0] + [(None, 1, 1), (data[0][0], 0, 0)], LABELS)


def dense(tokens, post, goal, rounds=20_000):
    """Projected gradient with momentum over an explicit vector of rates."""
    w = post @ (tokens @ post)
    r = y = np.ones(len(tokens))
    t, cost = 1.0, np.inf
    for _ in range(rounds):
        new = np.maximum(0, y - post @ ((tokens * y) @ post - goal) / w)
        last, cost = cost, np.square((tokens * new) @ post - goal).sum()
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, t = (new, 1.0) if cost > last else (new + (t - 1) / further * (new - r), further)
        r = new
    return r


def test_the_solver_against_a_dense_one_on_overlapping_and_infeasible_targets(spark):
    rng = np.random.default_rng(9)
    for case in range(9):
        n, d = int(rng.integers(3, 60)), int(rng.integers(2, 6))
        post = mixing.stepped(rng.dirichlet(np.full(d, rng.choice([0.1, 1.0, 5.0])), n))
        tokens = rng.integers(1, 400, n)
        share = rng.dirichlet(np.full(d, 0.5)) + 1e-3
        share /= share.sum()
        total = float(tokens.sum() * rng.choice([0.1, 1.0, 3.0]))
        names = [f"d{k}" for k in range(d)]
        cells = mixing.cut(spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, post)], "tokens long, post array<double>").coalesce(1))
        path = mixing.solve(cells, names, dict(zip(names, share)), total, mixing.ROUNDS, mixing.TOLERANCE)
        r = path.replay(post)[0]
        assert np.isfinite(r).all() and r.max() < 1e5
        usable = (tokens @ post) > 0
        goal = share * total if usable.all() else path.goal
        cost = lambda r: np.square(np.where(usable, (tokens * r) @ post - goal, 0)).sum() / total**2  # noqa: B023, E731
        want = cost(dense(tokens, post, goal))
        assert path.converged and cost(r) <= 1.01 * want + 1e-6, (case, cost(r), want)


def test_too_few_rounds_are_reported(spark):
    cells = mixing.cut(spark.createDataFrame([(10, [0.6, 0.4]), (20, [0.45, 0.55])], "tokens long, post array<double>"))
    with pytest.warns(UserWarning, match="aren't settled"):
        assert not mixing.solve(cells, ["a", "b"], {"a": 0.57, "b": 0.43}, 90.0, 1, 1e-9).converged


def test_domains_without_a_target_are_left_alone(spark):
    data = rows(150, 46)
    rate = {r["doc_id"]: r["rate"] for r in mixing.rates(frame(spark, data), labels(spark, data), targets={"en": 0.7, "de": 0.3}).collect()}
    assert all(abs(rate[i] - 1) < 0.1 for i, _, lang, *_ in data if lang == "fr")
    assert max(abs(rate[i] - 1) for i, _, lang, *_ in data if lang != "fr") > 0.3


def test_repeated_rows_of_a_labelled_document_are_learnt_once(spark):
    data = rows(60, 47)
    hot = data + data[:1] * 500
    (names, w), (again, v) = (mixing.fit(frame(spark, x), labels(spark, data), "doc_id", "text", "lang", 4000) for x in (data, hot))
    assert names == again and np.allclose(w, v)


def test_rates_equal_dense_projected_gradient_and_meet_the_targets(spark):
    data = rows(120, 41)
    out = mixing.rates(frame(spark, data), labels(spark, data), targets=T).collect()
    names = sorted(T)
    tokens = np.array([r["tokens"] for r in out], float)
    post = np.array([[r["posterior"][n] for n in names] for r in out])
    rate = np.array([r["rate"] for r in out])
    assert (rate >= 0).all()
    got = (tokens * rate) @ post
    assert np.allclose(got / got.sum(), [T[n] for n in names], atol=1e-3)
    want = dense(tokens, post, got.sum() * np.array([T[n] for n in names]))
    assert np.allclose(rate, want, atol=0.1)


def test_a_target_below_what_there_is_projects_to_zero_or_above(spark):
    data = rows(90, 42)
    out = mixing.rates(frame(spark, data), labels(spark, data), targets={"en": 0.98, "de": 0.01, "fr": 0.01}, total=3000.0).collect()
    assert min(r["rate"] for r in out) >= 0
    names = sorted(T)
    e = sum(np.array([r["posterior"][n] for n in names]) * r["rate"] * r["tokens"] for r in out)
    assert np.allclose(e / e.sum(), [0.01, 0.98, 0.01], atol=0.02)


def test_held_out_accuracy(spark):
    data = rows(300, 43)
    known = labels(spark, data, 4)
    out = mixing.rates(frame(spark, data), known).collect()
    lang = {r[0]: r[2] for r in data}
    held = [r for r in out if r["doc_id"] % 4]
    assert np.mean([max(r["posterior"], key=r["posterior"].get) == lang[r["doc_id"]] for r in held]) > 0.97


def test_copies_follow_the_rates(spark):
    data = rows(200, 44)
    rate = {r["doc_id"]: r["rate"] for r in mixing.rates(frame(spark, data), labels(spark, data), targets=T).collect()}
    n = {}
    for r in mixing.apply(frame(spark, data), labels(spark, data), targets=T).collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert all(n.get(i, 0) in (int(np.floor(x)), int(np.ceil(x))) for i, x in rate.items())
    assert sum(n.values()) == pytest.approx(sum(rate.values()), rel=0.08)


def test_odd_rows_clashing_columns_empty_tables(spark):
    data = rows(60, 45) + odd()
    known = labels(spark, data)
    out = mixing.apply(clashing(spark, data), known, targets=T)
    assert out.columns == clashing(spark, data).columns
    assert {repr(r["doc_id"]) for r in out.collect()} == {repr(r[0]) for r in data}
    assert mixing.apply(frame(spark, [], DOCS), known).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert mixing.apply(frame(spark, data), none).count() == len(data)
    assert {r["rate"] for r in mixing.rates(frame(spark, data), none).collect()} == {1.0}
    assert mixing.apply(frame(spark, data), known, targets={"xx": 1.0}).count() == len(data)
