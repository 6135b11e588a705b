"""What searches and packed corpora store, and what leaves the tasks that count pairs."""

import os
from datetime import datetime, timedelta, timezone

import pytest

from glosswork.operators import packed, search, stats
from glosswork.plans import roster
from glosswork.runtime import dropped, stored

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


@pytest.fixture
def kept(monkeypatch):
    """The tables that the operators store while a test runs."""
    out = []

    def noted(df):
        out.append(stored(df))
        return out[-1]

    for m in (search, packed, stats):
        monkeypatch.setattr(m, "stored", noted)
    return out


def test_a_search_stores_each_document_once_and_no_text(spark, sf, kept, monkeypatch):
    monkeypatch.setattr(packed, "dropped", lambda df: None)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    roster.queries()["prediction_error"](spark, sf)
    assert not any("text" in t.columns for t in kept)
    assert len([t for t in kept if any("array" in k for _, k in t.dtypes) and t.count() == n]) == 1


def test_a_search_scores_where_it_counts(spark, kept):
    """No pair of a query token and a token of a document leaves the task; repeated ids and unknown tokens included."""
    t0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
    docs = [(f"d{i % 30}", ["q1", "q2", *(f"x{i % 30}-{k}" for k in range(40)), "q1"], ["c"], t0 + timedelta(hours=i % 30), 1) for i in range(33)] + [("e", None, ["c"], t0, 0), ("f", [], ["c"], t0, 0)]
    d = spark.createDataFrame(docs, "doc_id string, tokens array<string>, cats array<string>, published_at timestamp, links_out int")
    q = spark.createDataFrame([("a", ["q1", "none"], ["q1", "none"], ["c"]), ("b", ["q2", "q1"], ["q2"], []), ("c", ["none"], ["none"], [])], "query_id string, tokens array<string>, wanted array<string>, cats array<string>")
    out = {(r["query_id"], r["doc_id"]): r for r in search.breakdown(d, q, NOW, k=1, min_df=2).collect()}
    assert {x for x, _ in out} == {"a", "b"} and len(out) == 8 and all(r["length"] == pytest.approx(3.78419) for r in out.values())
    places = [t for t in kept if "qi" in t.columns and "qt" not in t.columns]
    # five places wait for q1 at most and four for q2, and each token tells its neighbours once
    assert len(places) == 1 and places[0].count() <= 4 + 4 + 2


def test_a_packed_corpus_keeps_no_copy_of_its_tokens(spark, kept):
    c = spark.createDataFrame([(["aa", "bb"],), (["bb"],), (None,)], "tokens array<string>")
    p, words = packed.pack(c)
    sets = [t for t in kept if t.columns == ["v"]]
    assert len(sets) == 1 and p.n == 3 and {tuple(r) for r in words.collect()} == {("aa", 1), ("bb", 2)}
    with pytest.raises(Exception, match="(?i)exist|not_found"):
        sets[0].collect()


def test_a_stored_table_can_be_dropped(spark):
    t = stored(spark.range(5))
    at = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(at)
    dropped(t)
    assert not os.path.exists(at)


def test_only_pairs_of_one_query_leave_the_tasks(spark):
    c = spark.createDataFrame([(["aa", "bb", "cc", "dd"],)] * 3 + [(["aa", "dd"],)], "tokens array<string>")
    p, _ = packed.pack(c)
    groups = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "zz"), (2, "cc"), (2, "aa"), (3, "dd")], "query_id long, token string")
    out = packed.rows(spark, p, packed.among(p, groups), packed.SUPPORTED, half=True)
    assert sorted((r["t1"], r["t2"], r["n"]) for r in out.collect()) == [("aa", "bb", 3), ("aa", "cc", 3)]
