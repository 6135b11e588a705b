import random

import numpy as np
from glosswork.llm import simhash

from .frames import DOCS, clashing, frame, odd, prose, rows


def brute(data, threshold=simhash.THRESHOLD):
    """Groups by comparing all fingerprints with all, then one by one joining."""
    known = [(i, t) for i, t, *_ in data if i is not None and t is not None]
    fp = simhash.fingerprints([t for _, t in known], {})
    root = {i: i for i, _ in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    near = set()
    for a in range(len(known)):
        d = np.bitwise_count(fp[a] ^ fp).astype(int).sum(1)
        for b in np.flatnonzero(d <= threshold):
            x, y = top(known[a][0]), top(known[b][0])
            root[max(x, y)] = min(x, y)
            near.add((known[a][0], known[b][0]))
    return {i: top(i) for i, _ in known}, near


def copies(seed=11, n=150, each=3):
    rng = random.Random(seed)
    out = rows(n, seed, 80, 200)
    k = 1000
    for i, t, lang, s, c in list(out)[: n // 2]:
        for _ in range(rng.randint(1, each)):
            w = t.split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(["other", "thing", "zz"])
            out.append((k, " ".join(w), lang, s, c))
            k += 1
    return out


def test_code_covers():
    """Every point has an anchor within 1, and any two at most 2 bits apart share one of those they are sent to."""
    rng = np.random.default_rng(5)
    for length in {len(b) for b in simhash.BLOCKS}:
        x = rng.integers(0, 1 << length, 300).astype(np.uint64)
        who, where = simhash.anchors(x, length)
        dist = np.bitwise_count(where ^ x[who])
        assert dist.max() == 2 and set(who[dist <= 1]) == set(range(300))
        own = {i: set(where[who == i].tolist()) for i in range(300)}
        for i in range(300):
            y = int(x[i])
            for bit in rng.choice(length, rng.integers(0, 3), replace=False):
                y ^= 1 << int(bit)
            assert own[i] & set(simhash.anchors(np.array([y], np.uint64), length)[1].tolist())


def test_all_places_of_a_block_share_an_anchor():
    """Exhaustive over the syndromes and the differences of at most 2 bits."""
    for length in {len(b) for b in simhash.BLOCKS}:
        cols, patterns = simhash._code(length)
        sets = [set(p.tolist()) for p in patterns]
        for s in range(16):
            for i in range(length):
                for j in range(i + 1):
                    e = (1 << i) ^ (1 << j) if i != j else 1 << i
                    other = s ^ (cols[i] ^ cols[j] if i != j else cols[i])
                    assert sets[s] & {p ^ e for p in sets[other]}


def test_groups_equal_brute_force(spark):
    data = copies()
    want, near = brute(data)
    assert len(near) > 300
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(frame(spark, data)).collect()}
    assert got == want


def test_every_pair_within_the_threshold_is_found(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    b = a.copy()
    for x in b:
        for bit in rng.choice(128, rng.integers(1, simhash.THRESHOLD + 1), replace=False):
            x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows_ = [(int(h), int(w)) for h, w in np.concatenate([a, b]).view(np.int64)]
    anchored = spark.createDataFrame(rows_, "hi long, lo long").mapInArrow(simhash._replicate, "a long, hi long, lo long").repartition("a").sortWithinPartitions("a")
    edges = {tuple(r) for r in anchored.mapInArrow(simhash._compare(simhash.THRESHOLD), "h1 long, l1 long, h2 long, l2 long").distinct().collect()}
    x, y = a.view(np.int64), b.view(np.int64)
    linked = {frozenset([e[:2], e[2:]]) for e in edges}
    assert all(frozenset([tuple(map(int, p)), tuple(map(int, q))]) in linked for p, q in zip(x, y))


def test_small_and_large_anchors_connect_alike(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    fp = base[rng.integers(0, 6, 200)] ^ (np.uint64(1) << rng.integers(0, 63, (200, 2)).astype(np.uint64))
    a = np.sort(rng.integers(0, 5, 200))
    one = simhash.near_pairs(a, fp[:, 0], fp[:, 1], 17)
    monkeypatch.setattr(simhash, "SMALL", 1)
    two = simhash.near_pairs(a, fp[:, 0], fp[:, 1], 17)
    assert (simhash.roots(200, *one) == simhash.roots(200, *two)).all() and len(two[0]) < len(one[0])


def test_keep_one_keeps_one_of_each_group(spark):
    data = copies(12, 60)
    want, _ = brute(data)
    kept = [r["doc_id"] for r in simhash.keep_one(frame(spark, data)).collect()]
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(frame(spark, data)).collect()}
    assert sorted(kept) == sorted(set(got.values()))
    assert sorted(kept) == sorted(set(want.values()))


def test_odd_rows_and_clashing_columns(spark):
    data = odd()
    out = simhash.keep_one(clashing(spark, data))
    ids = sorted(repr(r["doc_id"]) for r in out.collect())
    # null texts and null ids stay; the row of 1003 that came twice stays once; 1001 and 1002 differ
    assert ids == sorted(map(repr, [1000, 1001, 1002, None, 1003, 1004, 1005, None, 1006]))
    assert out.columns == clashing(spark, data).columns
    g = {r["doc_id"]: r for r in simhash.groups(frame(spark, data)).collect()}
    assert 1000 not in g and g[1003]["group_size"] == 2 and g[1003]["keep"]


def test_a_large_group_and_an_empty_table(spark):
    t = prose(random.Random(1), "en", 100)
    data = [(i, t, "en", "s", 1) for i in range(3000)]
    assert [r["doc_id"] for r in simhash.keep_one(frame(spark, data)).collect()] == [0]
    assert simhash.groups(frame(spark, [], DOCS)).count() == 0
    assert simhash.keep_one(frame(spark, [], DOCS)).count() == 0


def test_rows_of_one_id_with_other_texts_are_one_document(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, lang, 120) for lang in ("en", "de", "fr"))
    data = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "de", "s", 1), (3, b, "de", "s", 1), (4, c, "fr", "s", 1), (4, None, "fr", "s", 1)]
    got = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in simhash.groups(frame(spark, data)).collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (4, 1)}
    assert sorted((r[0], r[1]) for r in simhash.keep_one(frame(spark, data)).select("doc_id", "text").collect() if r[1]) == [(1, a), (4, c)]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["v"]: r["root"] for r in simhash.components(e).collect()}
    assert set(got.values()) == {0, 500} and all(got.get(i, 0) == 0 for i in range(1, 201))
