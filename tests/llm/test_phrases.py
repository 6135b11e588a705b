import random

from glosswork.llm import phrases

from .frames import DOCS, clashing, frame, odd, prose, rows

W = phrases.MIN_WORDS


def brute(data):
    """Windows of W words as strings, counted over ids; runs of recurring ones."""
    docs = sorted({(i, t) for i, t, *_ in data if i is not None and t is not None})
    where = {}
    for i, t in docs:
        ws = t.lower().split()
        for p in range(len(ws) - W + 1):
            where.setdefault(" ".join(ws[p : p + W]), []).append((i, p))
    home = {k: min(v) for k, v in where.items() if len({i for i, _ in v}) > 1}
    out = []
    for i, t in docs:
        ws = t.lower().split()
        run = None
        for p in range(len(ws) - W + 2):
            h = home.get(" ".join(ws[p : p + W])) if p <= len(ws) - W else None
            if h and run is None:
                run = (p, h)
            elif not h and run is not None:
                out.append((i, run[0], p - 1 + W - run[0], *run[1]))
                run = None
    return sorted(out)


def data(seed=21):
    rng = random.Random(seed)
    shared = [prose(rng, lang, n) for lang, n in (("en", 60), ("de", 50), ("fr", 130), ("en", 49), ("en", 300))]
    out = []
    for i, t, *rest in rows(40, seed, 10, 120):
        parts = t.split(" ")
        for s in rng.sample(shared, rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), s)
        out.append((i, " ".join(parts), *rest))
    # parts of one passage, one passage twice in a document, a copy, one document that repeats itself alone
    w = shared[4].split(" ")
    out += [(100, " ".join(w[:170]), "en", "s", 1), (101, " ".join(w[90:]), "en", "s", 1), (102, shared[2] + " x " + shared[2], "fr", "s", 1), (103, out[3][1], "en", "s", 1)]
    own = prose(rng, "de", 70)
    return out + [(104, own + " y " + own, "de", "s", 1), (105, " ".join(["same"] * 200), "en", "s", 1), (106, " ".join(["same"] * 150), "en", "s", 1)] + odd()


def got(df):
    return sorted((r["doc_id"], r["start_word"], r["n_words"], r["first_doc"], r["first_start"]) for r in df.collect())


def test_equals_brute_force(spark):
    d = data()
    want = brute(d)
    assert len(want) > 20
    assert got(phrases.occurrences(frame(spark, d))) == want


def test_equals_brute_force_with_many_shards_tasks_and_steps(spark):
    d = data(22)
    assert got(phrases.occurrences(frame(spark, d), shard_words=200, step_windows=90)) == brute(d)


def test_a_passage_that_a_third_of_all_rows_hold_and_string_ids(spark):
    hot = prose(random.Random(5), "en", 90)
    d = [(f"d{i}", t + (" " + hot if i % 3 == 0 else "") + (" " + hot[:300] if i % 7 == 0 else ""), *r) for i, t, *r in rows(240, 23, 10, 60)]
    d += d[:3] * 2
    schema = DOCS.replace("doc_id long", "doc_id string")
    for kw in ({}, {"shard_words": 30, "step_windows": 64}):
        assert got(phrases.occurrences(frame(spark, d, schema).repartition(3), **kw)) == brute(d)


def test_extra_columns_are_not_read(spark):
    d = data(24)
    assert got(phrases.occurrences(clashing(spark, d))) == brute(d)


def test_least_two():
    import numpy as np

    rng = random.Random(1)
    rows_ = [(rng.randint(0, 3), rng.randint(0, 5), rng.randint(0, 4), rng.randint(0, 9)) for _ in range(400)]
    kept = phrases._least_two(*(np.array(x) for x in zip(*rows_)))
    want = []
    for key in {r[:2] for r in rows_}:
        one = min(r[2:] for r in rows_ if r[:2] == key)
        other = [r[2:] for r in rows_ if r[:2] == key and r[2] != one[0]]
        want += [(*key, *one), *([(*key, *min(other))] if other else [])]
    assert sorted(rows_[i] for i in kept) == sorted(want)


def test_empty_and_without_repeats(spark):
    assert phrases.occurrences(frame(spark, [], DOCS)).count() == 0
    assert got(phrases.occurrences(frame(spark, [(1, "a b c", "en", "s", 1), (2, None, "en", "s", 1)]))) == []


def test_every_window_holds_a_seed_with_a_word_of_its_own():
    for n in range(W, 400):
        at = phrases.seed_places(n)
        assert all(any(i <= o <= i + W - phrases.SEED for o in at) for i in range(n - W + 1))
        assert all(o + phrases.SEED > min(W - 1, n - W) and o <= max(W - 1, n - W) for o in at)
