import unicodedata
from collections import defaultdict

from glosswork.llm import digest

from .frames import DOCS, clashing, frame, odd, rows


def brute(data):
    by = defaultdict(list)
    for i, t, *_ in data:
        if t is not None:
            c = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
            by[" ".join(c.split())].append(i)
    out = []
    for i, t, *_ in data:
        if t is None:
            out.append((repr(i), repr(i), 1))
        else:
            c = " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
            ids = [x for x in by[c] if x is not None]
            out.append((repr(i), repr(min(ids) if ids else None), len(by[c])))
    return sorted(out)


def got(df):
    return sorted((repr(r["doc_id"]), repr(r["group_id"]), r["group_size"]) for r in df.collect())


DATA = rows(40) + odd() + [(50, "Straße  ﬁn", "de", "a", 1), (51, "STRASSE\nfin ", "de", "a", 1), (52, "strasse fin", "de", "b", 1), (53, "strasse fin!", "de", "b", 1), (54, "", "en", "c", 1)]


def test_groups_equal_brute_force_by_broadcast_and_by_shuffle(spark):
    df = frame(spark, DATA)
    assert got(digest.groups(df)) == brute(DATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(digest.groups(clashing(spark, DATA))) == brute(DATA)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hash_collision_is_split_by_the_bytes(spark, monkeypatch):
    real = digest.digests

    def colliding(docs, id_col, text_col, with_text):
        from pyspark.sql import functions as F

        df = real(docs, id_col, text_col, with_text)
        return df.withColumns({"hi": F.when(F.col("hi").isNotNull(), F.lit(1).cast("long")), "lo": F.when(F.col("lo").isNotNull(), F.lit(2).cast("long"))})

    monkeypatch.setattr(digest, "digests", colliding)
    assert got(digest.groups(frame(spark, DATA))) == brute(DATA)


def test_empty_table(spark):
    assert digest.groups(frame(spark, [], DOCS)).count() == 0
