import random

import numpy as np
from glosswork.llm import lines

from .frames import DOCS, clashing, frame, odd, rows


def brute(data, most, least):
    count = {}
    split = [(i, None if t is None else t.split("\n")) for i, t, *_ in data]
    for _, ls in split:
        for k in {x.strip(" \t\r") for x in ls or []}:
            if len(k) >= least:
                count[k] = count.get(k, 0) + 1
    out = []
    for i, ls in split:
        if ls is None:
            out.append((repr(i), 0, 0, None))
        else:
            keep = [x for x in ls if count.get(x.strip(" \t\r"), 0) <= most]
            out.append((repr(i), len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def data():
    rng = random.Random(6)
    common = [f"a line that many documents have, number {n}" for n in range(5)]
    out = []
    for i, t, *rest in rows(60, 7):
        ls = t.split("\n")
        for _ in range(rng.randint(0, 3)):
            ls.insert(rng.randint(0, len(ls)), "  " * rng.randint(0, 1) + rng.choice(common) + "\r" * rng.randint(0, 1))
        out.append((i, "\n".join(ls), *rest))
    return out + odd() + [(70, common[0] + "\n" + common[0], "en", "x", 1)]


def test_perfect_hash_is_minimal_and_answers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 20_000):
        keys = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
        counts = rng.integers(1, 400, len(keys))
        m = lines.Mph.load(lines.Mph(keys, counts).dump())
        assert sorted(m.slots(keys)) == list(range(len(keys)))
        assert (m.counts(keys) == np.minimum(counts, 255)).all()
        other = rng.integers(1, 1 << 63, 5000).astype(np.uint64)
        assert (m.counts(other) != 0).mean() < 0.01


def test_equals_brute_force_with_one_shard_and_many(spark):
    d = data()
    want = brute(d, 5, 20)
    show = lambda df: sorted(((repr(r[0]), *r[1:]) for r in map(tuple, df.collect())), key=repr)
    assert show(lines.dedup(frame(spark, d))) == want
    assert show(lines.dedup(clashing(spark, d), shard_keys=50)) == want
    assert show(lines.dedup(frame(spark, d).repartition(5), shard_keys=3)) == want


def test_empty_table(spark):
    assert lines.dedup(frame(spark, [], DOCS)).count() == 0
