from datetime import datetime

from pyspark.sql import functions as F

from glosswork.operators import stats
from glosswork.streaming import store as st

DOC = "url string, tokens array<string>, published_at timestamp"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def counts(s):
    return {r["token"]: r["df"] for r in s.read("token_df").collect()}, {(r["t1"], r["t2"]): r["n"] for r in s.read("token_pairs").collect()}


def test_ingest_again_takes_the_old_statistics_back(spark, tmp_path):
    s = st.Store(spark, str(tmp_path))
    assert s.read("docs") is None and s.view("stoplist") is None
    s.ingest(spark.createDataFrame([("u", ["alpha", "beta", "beta"], T0), ("v", ["beta", "gamma"], T0)], DOC))
    assert counts(s) == ({"alpha": 1, "beta": 2, "gamma": 1}, {("alpha", "beta"): 1, ("beta", "gamma"): 1})
    s.ingest(spark.createDataFrame([("u", ["alpha", "delta"], T0), ("u", ["alpha", "gamma"], T1)], DOC))
    assert counts(s) == ({"alpha": 1, "beta": 1, "gamma": 2}, {("alpha", "gamma"): 1, ("beta", "gamma"): 1})
    assert s.read("docs").count() == 2
    # what was merged equals what a full count gives
    d = s.read("docs").withColumn("doc_id", F.col("url"))
    assert counts(s)[0] == {r["token"]: r["df"] for r in stats.frequencies(stats.members(d)).collect()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    s = st.Store(spark, str(tmp_path))
    b = spark.createDataFrame([("u", ["alpha", "beta"], T0)], DOC)
    s.ingest(b, version=0)
    s.ingest(b, version=0)
    assert counts(s) == ({"alpha": 1, "beta": 1}, {("alpha", "beta"): 1})


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path):
    s = st.Store(spark, str(tmp_path))
    b = spark.createDataFrame([("u", ["alpha", "beta"], T0)], DOC)
    s.ingest(b, version=0)
    new = spark.createDataFrame([("w", ["alpha"], T0)], DOC)
    # documents and counts of version 1 were written, its commit mark was not: nobody sees them
    s._put("docs", new.withColumn("version", F.lit(1).cast("long")), "v1")
    s._put("token_df", spark.createDataFrame([("alpha", 1)], "token string, d long"), "v1")
    assert counts(s)[0] == {"alpha": 1, "beta": 1} and s.read("docs").count() == 1
    s.ingest(new, version=1)
    assert counts(s)[0] == {"alpha": 2, "beta": 1} and s.read("docs").count() == 2


def test_compaction_changes_nothing_and_lookups_read_their_buckets(spark, tmp_path):
    s = st.Store(spark, str(tmp_path))
    for v in range(4):
        s.ingest(spark.createDataFrame([("u", ["alpha", f"word{v}"], T0), (f"v{v}", ["alpha", "beta"], T1)], DOC), version=v)
    before = counts(s), sorted(r["url"] for r in s.read("docs").collect())
    s.compact()
    assert (counts(s), sorted(r["url"] for r in s.read("docs").collect())) == before
    s.ingest(spark.createDataFrame([("u", ["beta"], T1)], DOC), version=4)
    s.compact()
    s.compact()
    assert counts(s) == ({"alpha": 4, "beta": 5}, {("alpha", "beta"): 4})
    assert s.versions("docs") == [4] and s.versions("docs", "base") == [3, 4]
    assert {(r["token"], r["neighbor"], r["n"]) for r in s.pairs(["beta"]).collect()} == {("beta", "alpha", 4)}
    assert {r["url"] for r in s.holding(["alpha"]).collect()} == {f"v{v}" for v in range(4)}
    assert {r["token"]: r["df"] for r in s.frequencies(["beta", "none"]).collect()} == {"beta": 5}
    assert s.document(url="u").first()["tokens"] == ["beta"] and s.document(url="w").count() == 0
    plan = s.holding(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_stop_list_and_listings(spark):
    s = st.Store.passing(spark)
    s.add_stops(["The", "and"])
    s.add_stops(["and", "of"])
    s.remove_stops(["AND"])
    assert [r["token"] for r in s.listing("stoplist", "token").collect()] == ["of", "the"] and s.listing("dict", "phrase") is None


def test_stream(spark, tmp_path):
    for n, rows in enumerate(([("u", ["alpha", "beta"], T0)], [("u", ["beta"], T1), ("v", ["beta"], T1)])):
        spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = st.Store(spark, str(tmp_path / "store"))
        q = st.follow(spark.readStream.schema(DOC).parquet(str(tmp_path / "in")), s, str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
    assert counts(s) == ({"beta": 2}, {})


def test_stream_trends(spark, tmp_path):
    spark.createDataFrame([("u", ["alpha", "alpha"], T0), ("v", ["alpha"], T0), ("w", ["beta"], T1)], DOC).write.parquet(str(tmp_path / "in"))
    q = st.trends(spark.readStream.schema(DOC).parquet(str(tmp_path / "in")), "published_at").writeStream.format("memory").queryName("trend").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["token"], r["n"]) for r in spark.table("trend").collect()} == {("alpha", 2), ("beta", 1)}


def test_small_tables(spark, tmp_path):
    s = st.Store(spark, str(tmp_path))
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "token string")
    s.replace("stoplist", one("a", "b"))
    s.replace("stoplist", one("c"))
    assert [r["token"] for r in s.view("stoplist").collect()] == ["c"]
    entry = lambda *r: spark.createDataFrame(list(r), "phrase string, canonical string, category string")
    s.put("dict", entry(("ml", "machine learning", "ai")), "phrase")
    s.put("dict", entry(("ml", "m l", "x"), ("nn", "neural network", "ai")), "phrase")
    assert {r["phrase"]: r["canonical"] for r in s.view("dict").collect()} == {"ml": "m l", "nn": "neural network"}
    s.put("cards", spark.createDataFrame([(f"c{i}", "w1") for i in range(12)], "id string, period string"), "id")
    assert len(s.cards("w1", 0).collect()) == 10 and s.cards("w1", 2).first()["id"] == "c9"
    s.replace("stoplist", one("d"))
    s.replace("stoplist", one("e"))
    assert len(s.versions("stoplist")) == 3


def test_cleaner(spark):
    d = spark.createDataFrame([(1, "a b", ["a", "b"]), (2, "a", ["a"]), (3, None, None)], "doc_id long, text string, tokens array<string>")
    new = F.filter(F.split("text", " "), lambda x: x != "b")
    assert [(r["doc_id"], r["tokens"]) for r in st.cleaned(d, new).collect()] == [(1, ["a"])]
    assert tuple(st.cleaner_counts(d, new).first()) == (3, 1, 1)
