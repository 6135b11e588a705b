import math
import random

import numpy as np
from glosswork.llm import quality

from .frames import DOCS, LABELS, clashing, frame, junk, odd, rows


def corpus(n=300, seed=51):
    rng = random.Random(seed)
    out, truth = [], {}
    for i, t, lang, s, c in rows(n, seed):
        bad = rng.random() < (0.7 if s == "src3" else 0.1)
        truth[i] = int(not bad)
        out.append((i, junk(rng, 60) if bad else t, lang, s + "/p" + str(i % 2), c))
    return out, truth


def labels(spark, truth, every=2):
    return spark.createDataFrame([(i, y, 0) for i, y in truth.items() if i % every == 0] + [(None, 1, 0), (5, None, 0)], LABELS)


def brute(data, w, base):
    """Posteriors of every document with loops over sites."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    logits = [float(np.clip(quality.features([t])[0] @ w[:-1] + w[-1], -30, 30)) if t else base for _, t, *_ in data]
    site = [((s or "").split("/")[0], "/".join(x for x in [None if s is None else "/".join(s.split("/")[1:]), lang] if x is not None)) for _, _, lang, s, _ in data]
    own = [sig(x) for x in logits]

    def strength(keys):
        g = {}
        for k, e in zip(keys, own):
            x = g.setdefault(k, [0, 0.0])
            x[0] += 1
            x[1] += e
        n, s, k = len(own), sum(own), len(g)
        m = min(max(s / n, 1e-4), 1 - 1e-4)
        free = n - sum(a * a for a, _ in g.values()) / n
        between = (sum(b * b / a for a, b in g.values()) - n * m * m - (k - 1) * m * (1 - m)) / free if k > 1 and free > 0 else 0
        return g, m, min(1e6, max(2.0, m * (1 - m) / between - 1)) if between > 0 else 1e6

    hosts, m, kh = strength([x[0] for x in site])
    paths, _, kp = strength(site)
    out = {}
    for d, x, lo, o in zip(data, site, logits, own):
        h = (max(0, hosts[x[0]][1] - o) + kh * m) / (max(0, hosts[x[0]][0] - 1) + kh)
        p = (max(0, paths[x][1] - o) + kp * h) / (max(0, paths[x][0] - 1) + kp)
        p = min(1 - 1e-6, max(1e-6, p))
        out.setdefault(repr(d[0]), []).append(sig(lo + math.log(p / (1 - p)) - math.log(m / (1 - m))))
    return out


def test_posteriors_equal_brute_force(spark):
    data, truth = corpus()
    data = data + odd()
    df, known = frame(spark, data), labels(spark, truth)
    w, mean = quality.fit(df, known, "doc_id", "text", "quality", quality.MAX_LABELLED)
    want = brute(data, w, math.log(mean / (1 - mean)))
    got = {}
    for r in quality.posteriors(df, known).collect():
        got.setdefault(repr(r["doc_id"]), []).append(r["posterior"])
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), atol=2e-6), i
    kept = sorted(repr(r["doc_id"]) for r in quality.keep(clashing(spark, data), known).collect())
    assert kept == sorted(i for i, ps in want.items() for x in ps if x >= quality.THRESHOLD)


def test_a_label_does_not_move_its_own_site(spark, monkeypatch):
    """The classifier held fixed, a document alone on its site has the same site posterior whatever its label."""
    data, truth = corpus(100, 55)
    data.append((7777, data[0][1], "en", "lonely/x", 1))
    fixed = quality.fit(frame(spark, data), labels(spark, truth), "doc_id", "text", "quality", quality.MAX_LABELLED)
    monkeypatch.setattr(quality, "fit", lambda *a, **kw: fixed)
    site = [quality.posteriors(frame(spark, data), labels(spark, truth | {7778: 1}).union(spark.createDataFrame([(7777, y, 0)], LABELS))).where("doc_id = 7777").first()["site_p"] for y in (0, 1)]
    assert site[0] == site[1]


def test_repeated_rows_of_a_labelled_document_are_learnt_once(spark):
    data, truth = corpus(80, 56)
    (w, m), (v, n) = (quality.fit(frame(spark, x), labels(spark, truth), "doc_id", "text", "quality", quality.MAX_LABELLED) for x in (data, data + data[:1] * 300))
    assert m == n and np.allclose(w, v, atol=1e-6)


def test_held_out_accuracy_keeps_the_clean(spark):
    data, truth = corpus(400, 52)
    kept = {r["doc_id"] for r in quality.keep(frame(spark, data), labels(spark, truth, 4)).collect()}
    held = [i for i in truth if i % 4]
    assert np.mean([(i in kept) == bool(truth[i]) for i in held]) > 0.97
    clean = [i for i in held if truth[i]]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_odd_rows_clashing_columns_empty_tables(spark):
    data, truth = corpus(90, 53)
    data = data + odd()
    out = quality.keep(clashing(spark, data), labels(spark, truth))
    assert out.columns == clashing(spark, data).columns
    assert sum(r["doc_id"] == 1003 for r in out.collect()) in (0, 2)
    assert quality.keep(frame(spark, [], DOCS), labels(spark, truth)).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert quality.keep(frame(spark, data), none).count() == len(data)
    assert quality.keep(frame(spark, data), spark.createDataFrame([(0, 1, 0)], LABELS)).count() == len(data)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(54)
    docs, marks, given = rows(800, 54), ["vile", "wretch", "filth"], []
    docs = [(i, t, lang, "src0", c) for i, t, lang, _, c in docs]
    toxic = {i for i in range(800) if rng.random() < 0.15} | {799}
    for k, (i, t, lang, s, c) in enumerate(docs):
        w = t.split() * (40 if i == 799 else 1)  # the last is long and has its insults at the end
        for mark in rng.sample(marks, rng.randint(1, 3)) if i in toxic else ():
            w.insert(len(w) if i == 799 else rng.randrange(len(w)), mark)
        docs[k] = (i, " ".join(w), lang, s, c)
        if i % 2 == 0:
            given.append((i, 1, int(i in toxic)))
    kept = {r["doc_id"] for r in quality.keep(frame(spark, docs), spark.createDataFrame(given, LABELS)).collect()}
    held = [i for i in range(800) if i % 2]
    assert not [i for i in held if i in toxic and i in kept]
    assert not [i for i in held if i not in toxic and i not in kept]


def test_null_toxic_is_no_label_and_toxic_alone_is_bad(spark):
    table = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, None, 0), (4, 1, 1), (5, 0, 0), (6, 1, 0), (6, 1, 1)], LABELS)
    got = {r["__gw_lid"]: r["__gw_y"] for r in quality.labelled(table, "doc_id", "quality", "toxic").collect()}
    assert got == {1: 1.0, 2: 0.0, 4: 0.0, 5: 0.0, 6: 0.5}
