"""What the second round mended."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.functions import text
from glosswork.operators import packed, search, stats, tagging


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_keep_the_newest_of_each_token_before_queries_join(spark):
    rng, t0 = random.Random(5), datetime(2024, 1, 1, tzinfo=timezone.utc)
    docs = [(i % 60, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))], t0 + timedelta(hours=rng.randint(0, 9))) for i in range(64)]
    docs = [(i, t, dict((k, p) for k, _, p in docs)[i]) for i, t, _ in docs]  # a repeated id has one time
    queries = [(q, rng.sample("abcdefghz", 3)) for q in range(12)] + [(99, [])]
    d = spark.createDataFrame(docs, "doc_id long, tokens array<string>, published_at timestamp")
    out = search.candidates(d, spark.createDataFrame(queries, "query_id long, wanted array<string>"), 5)
    assert "WindowGroupLimit [token" in plan(out)
    expected = {(q, i) for q, w in queries for i in [i for _, i in sorted({(-p.timestamp(), i) for i, t, p in docs if set(t) & set(w)})][:5]}
    assert {(r["query_id"], r["doc_id"]) for r in out.collect()} == expected and out.count() == len(expected)


def test_tokens_of_plain_letters_meet_no_regular_expression(spark):
    x = spark.createDataFrame([("a--b -c- 12 1-2 x ab É-é 9a İstanbul ٣٤ {z ~q Zz -- ab--- naïve źz",)], "text string")
    out = x.select(text.tokens(F.col("text")).alias("t"))
    plain = F.transform(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0)), lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^-+|-+$", ""), "-{2,}", "-"))
    plain = x.select(F.filter(plain, lambda c: (F.octet_length(c) > 1) & ~c.rlike(r"^[\p{Nd}-]+$")).alias("t"))
    assert out.first() == plain.first() and "ab" in out.first()["t"]
    assert "Contains(" in plan(out) or "contains(" in plan(out).lower()


def documents():
    rng = random.Random(7)
    return [[rng.choice(["aa", "bb", "cc", "dd", "éé", "x-y"]) for _ in range(rng.randint(0, 12))] for _ in range(40)] + [None, []]


def brute(window, ordered):
    out = Counter()
    for d in documents():
        found = [(i, j) for i in range(len(d or [])) for j in range(i + 1, min(len(d), i + window))]
        out.update((d[i], d[j]) for i, j in found) if ordered else out.update({tuple(sorted((d[i], d[j]))) for i, j in found if d[i] != d[j]})
    return out


@pytest.mark.parametrize("near", [1, 9, 50, 10**6])
@pytest.mark.parametrize("window, ordered", [(5, False), (2, True)])
def test_near_pairs_are_counted_in_bounded_pieces(monkeypatch, near, window, ordered):
    monkeypatch.setattr(stats, "NEAR", near)
    lists = pa.array(documents(), pa.list_(pa.string()))
    tables = [pa.RecordBatch.from_arrays([x], names=["t"]) for x in (lists.slice(0, 11), lists.slice(11))]
    got, held = Counter(), list(stats.near_pieces(tables))
    assert sum(len(x) for h in held for x in h) == len(lists)
    assert all(sum(len(x.flatten()) for x in h) < near + 12 for h in held)  # a document has 12 at most
    for h in held:
        for t in stats._near_counts(h, window, ordered):
            for a, b, n in zip(*(t.column(c).to_pylist() for c in "abn")):
                got[a, b] += n
    assert got == brute(window, ordered)


@pytest.mark.parametrize("support", [1, 3, 9, 41])
def test_linked_pairs_are_counted_as_numbers(spark, support):
    c = spark.createDataFrame([(t,) for t in documents()] + [(["rare", "aa", "bb"],)], "tokens array<string>")
    links, n = packed.skip_links(c, support)
    assert n == 43 and "Join" not in plan(links)
    more = brute(5, False) + Counter({("aa", "rare"): 1, ("bb", "rare"): 1, ("aa", "bb"): 1})
    df = Counter(w for t in [*documents(), ["rare", "aa", "bb"]] for w in set(t or []))
    assert {tuple(r) for r in links.collect()} == {(a, b, k, df[a], df[b]) for (a, b), k in more.items() if k >= support}


def test_phrases_are_parsed_in_bounded_pieces(monkeypatch):
    p, lists = tagging.Phrases([("x-y aa", ["aa bb cc"]), ("dd", ["cc"])]), pa.array(documents(), pa.list_(pa.string()))
    monkeypatch.setattr(tagging, "PIECE", 20)
    held = [lists.slice(a, n) for a, n in tagging.pieces(lists)]
    assert all(len(x.flatten()) <= 20 for x in held) and len(held) > 5
    assert [y for x in held for y in p.parsed(x).to_pylist()] == [None if d is None else p.parse(d) for d in documents()]
    assert p.parse("aa bb cc AA bb x-y Aa cc".split()) == ["x-y aa", "AA", "bb", "x-y aa", "dd"]
