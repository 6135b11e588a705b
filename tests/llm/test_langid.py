import math
import random

import numpy as np
import pytest
from glosswork.llm import langid
from pyspark.sql import functions as F

from .frames import DOCS, clashing, frame, odd, prose, rows

B, K = langid.BITS, langid.ORDER


class Naive:
    """The recursion over dictionaries, from the symbols of the training texts of one language."""

    def __init__(self, texts, alphabet):
        self.count = [{} for _ in range(K + 1)]
        for seq in map(tuples, texts):
            for x in seq:
                self.count[K][x] = self.count[K].get(x, 0) + 1
        for k in range(K - 1, 0, -1):
            for x in self.count[k + 1]:
                self.count[k][x[1:]] = self.count[k].get(x[1:], 0) + 1
        self.floor, self.d, self.ctx = 1 / (alphabet + 1), {}, [{} for _ in range(K + 1)]
        for k in range(1, K + 1):
            n1, n2 = (sum(v == j for v in self.count[k].values()) for j in (1, 2))
            self.d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for x, c in self.count[k].items():
                t = self.ctx[k].setdefault(x[:-1], [0, 0])
                t[0] += c
                t[1] += 1

    def p(self, x):
        if not x:
            return self.floor
        lower, k = self.p(x[1:]), len(x)
        if x[:-1] not in self.ctx[k]:
            return lower
        total, kinds = self.ctx[k][x[:-1]]
        return (max(self.count[k].get(x, 0) - self.d[k], 0) + self.d[k] * kinds * lower) / total


def tuples(text):
    sym, _ = langid.symbols([text])
    sym = sym.tolist()
    return [tuple(sym[i - K + 1 : i + 1]) for i in range(K - 1, len(sym))]


def brute(data, held):
    """(id, language, best, bits, symbols) of every row."""
    train = {}
    for (_, t, lang, *_), out in zip(data, held):
        if lang is not None and t is not None and not out and tuples(t):
            train.setdefault(lang, []).append(t)
    alphabet = len({x[-1] for ts in train.values() for t in ts for x in tuples(t)})
    models = {lang: Naive(ts, alphabet) for lang, ts in sorted(train.items())}
    got = []
    for i, t, lang, *_ in data:
        seq = tuples(t) if t else []
        h = {x: sum(-math.log2(m.p(g)) for g in seq) / len(seq) for x, m in models.items()} if seq else {}
        best = min(h, key=lambda x: (round(h[x], 9), x)) if h else None
        got.append((i, best, h.get(best), len(seq)))
    limit = {}
    for x in models:
        own = sorted(b for (_, best, b, n), d, out in zip(got, data, held) if out and best == x == d[2] and n >= langid.MIN_SYMBOLS)
        limit[x] = own[max(0, math.ceil(langid.REJECT_QUANTILE * len(own)) - 1)] + langid.MARGIN if own else 1e9
    return sorted((repr(i), best if best and (b <= limit[best] or n < langid.MIN_SYMBOLS) else "und", repr(best), b, n) for i, best, b, n in got)


def data():
    rng = random.Random(3)
    wrong = [(i + 5000, t, None, s, n) for i, t, _, s, n in rows(20, 32)]
    noise = [(9000 + k, "".join(rng.choice("qxzwkjvbpg") for _ in range(120)), None, "s", 1) for k in range(6)]
    # a script of many symbols, and one text under two languages, which then tie
    han = [(7000 + k, "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(90)), "zh", "s", 1) for k in range(25)]
    same = [(8000 + k, "xyzzy plugh frobozz " * 3, lang, "s", 1) for k, lang in enumerate(("ya", "yb"))]
    return rows(90, 31, 20, 50) + wrong + noise + han + same + [r for r in odd() if len(r[1] or "") < 5000]


def test_the_whole_query_equals_brute_force(spark):
    d = data()
    docs = frame(spark, [(k, *r[1:]) for k, r in enumerate(d)])
    held = [r["h"] for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(langid.HELD_OUT)) == 0).alias("h")).orderBy("doc_id").collect()]
    want = brute(d, held)
    got = sorted(((repr(r[0]), r[1], repr(r[2]), *r[3:]) for r in map(tuple, langid.identify(frame(spark, d)).collect())), key=lambda r: (r[0], r[4]))
    want.sort(key=lambda r: (r[0], r[4]))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all((g[3] is None) == (w[3] is None) and (g[3] is None or g[3] == pytest.approx(w[3], abs=2e-5)) for g, w in zip(got, want))
    assert {g[1] for g in got} >= {"en", "de", "fr", "zh", "ya", "und"}


def test_probabilities_sum_to_one_over_the_alphabet(spark):
    d = [(lang, t) for _, t, lang, *_ in data() if lang in ("en", "zh") and len(t or "") > 20]
    names, models = langid.train(spark.createDataFrame(d, "lang string, t string"))
    letters = np.unique(np.concatenate([np.array([x[-1] for x in tuples(t)]) for _, t in d]))
    for m in models:
        ctx = np.unique([langid.grams(langid.symbols([t])[0])[K] >> B for lang, t in d if lang == m.lang])[:20]
        for c in ctx:
            p = 2.0 ** -m.bits((c << B) | letters.astype(np.int64))
            assert p.sum() + m.floor >= 0.97 and p.sum() <= 1 + 1e-9


def test_no_gram_is_left_out_and_many_shards_answer_alike(spark, monkeypatch):
    d = [(lang, t) for _, t, lang, *_ in rows(60, 8)]
    frame_ = spark.createDataFrame(d, "lang string, t string")
    q = np.unique(np.concatenate([langid.grams(langid.symbols([t])[0])[K:] for _, t in d]))
    one = [m.bits(q) for m in langid.train(frame_)[1]]
    real = langid.shelve
    monkeypatch.setattr(langid, "shelve", lambda df: real(df, 500))
    many = langid.train(frame_)[1]
    assert many[0].shelf.bits >= 4
    assert all(np.array_equal(a, m.bits(q)) for a, m in zip(one, many))
    counted = langid.gram_counts(frame_).count()
    assert counted == sum(len({x for t in [t for lg, t in d if lg == lang] for x in tuples(t)}) for lang in ("en", "de", "fr"))


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(3)
    train = rows(240, 31)
    wrong = [(i + 5000, t, None, s, n) for i, t, _, s, n in rows(90, 32)]
    noise = [(9000 + k, "".join(rng.choice("qxzwkjvbpg") for _ in range(300)), None, "s", 1) for k in range(20)]
    got = {r["doc_id"]: r["language"] for r in langid.identify(frame(spark, train + wrong + noise)).collect()}
    truth = {i + 5000: lang for i, _, lang, *_ in rows(90, 32)}
    assert np.mean([got[i] == lang for i, lang in truth.items()]) >= 0.97
    assert sum(got[9000 + k] == "und" for k in range(20)) >= 19


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    d = rows(60) + odd()
    out = langid.identify(clashing(spark, d)).collect()
    assert len(out) == len(d)
    by = {r["doc_id"]: r for r in out}
    assert by[1000]["language"] == by[1001]["language"] == "und" and by[1000]["bits"] is None
    assert by[1005]["language"] != "und"
    assert langid.identify(frame(spark, [], DOCS)).count() == 0
    assert {r["language"] for r in langid.identify(frame(spark, [(1, "abc", None, "s", 1)])).collect()} == {"und"}
