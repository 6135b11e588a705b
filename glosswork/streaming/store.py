"""Tables that are kept up to date: keyed upserts, signed deltas of the statistics, and the stream that applies them.

The corpus is a log. A batch writes what is new under its version - documents, the versions of those that they replace,
signed counts of tokens and pairs, and postings - and then one commit mark, so a reader sees all of a batch or nothing
of it, and a lost executor or a repeated batch changes nothing. Readers add the log up; compact() folds it into a base
every COMPACT batches, so a batch costs what it brings and not what there is. Pairs and postings lie in buckets by token:
a query reads the buckets of its own tokens. Small tables are folders of versions of which the newest finished counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import members
from ..runtime import shared, stored


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new, which replace those of their key. Of several new rows of a key, the last by order (then
    by content) stays."""
    rest = [F.col(f"`{c}`") for c in new.columns if c not in (key, order)]
    w = Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), F.xxhash64(*rest) if rest else F.lit(0))
    last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.join(last.select(key), key, "left_anti").select(*last.columns).union(last)


def doc_pairs(docs: DataFrame) -> DataFrame:
    """(t1, t2) of the distinct tokens of each document."""
    v = docs.select(F.array_sort(F.array_distinct("tokens")).alias("v"))
    left = v.select("v", F.posexplode("v").alias("p", "t1")).where(F.col("p") + 1 < F.size("v"))
    return left.select("t1", F.explode(F.slice("v", F.col("p") + 2, F.size("v"))).alias("t2"))


def deltas(old: DataFrame, new: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """((token, d), (t1, t2, d)): -1 for each document that goes, +1 for each that comes; zeros left out."""
    df = members(old, key).select("token", F.lit(-1).alias("d")).union(members(new, key).select("token", F.lit(1)))
    pairs = doc_pairs(old).select("t1", "t2", F.lit(-1).alias("d")).union(doc_pairs(new).select("t1", "t2", F.lit(1)))
    add = lambda x, *k: x.groupBy(*k).agg(F.sum("d").cast("long").alias("d")).where("d <> 0")
    return add(df, "token"), add(pairs, "t1", "t2")


def merged(counts: DataFrame, change: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts with a signed change; keys that fall to 0 or below go."""
    both = counts.select(*keys, F.col(count).alias("d")).union(change.select(*keys, "d"))
    return both.groupBy(*keys).agg(F.sum("d").cast("long").alias(count)).where(F.col(count) > 0)


#: Buckets of pairs and postings, and batches between two compactions.
BUCKETS, COMPACT = 64, 16


def bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(F.col(token)), F.lit(BUCKETS)).cast("int")


class Store:
    """docs(url, doc_id, tokens, ...), token_df(token, df), token_pairs(t1, t2, n), postings, and small tables by name."""

    LOG = ("docs", "gone", "token_df", "token_pairs", "postings")
    SCHEMAS = {"token_df": "token string, d long, bucket int", "token_pairs": "token string, neighbor string, d long, bucket int", "postings": "token string, url string, doc_id long, published_at timestamp, version long, bucket int"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def passing(cls, spark: SparkSession) -> "Store":
        """A store that goes with the session."""
        return cls(spark, shared(spark))

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self, name: str, mark: str = "v") -> list[int]:
        """The finished versions of a table, or of its bases."""
        fs, path = self._fs()
        at = path(f"{self.folder}/{name}")
        if not fs.exists(at):
            return []
        done = (s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(mark))
        return sorted(int(p.getName()[len(mark) :]) for p in done if fs.exists(path(f"{p.toString()}/_SUCCESS")))

    def committed(self) -> list[int]:
        return self.versions("commits")

    def _log(self, name: str) -> tuple[DataFrame | None, list[int]]:
        """(rows of the newest base and of the committed versions after it, those versions)."""
        done = self.committed()
        base = [v for v in self.versions("commits", "base") if done and v <= done[-1]]
        after = [v for v in done if not base or v > base[-1]]
        folders = [f"{self.folder}/{name}/base{v}" for v in base[-1:]] + [f"{self.folder}/{name}/v{v}" for v in after]
        if not folders:
            return None, []
        # without a schema of its own a log that has no row yet couldn't be read
        reader = self.spark.read.schema(self.SCHEMAS[name]) if name in self.SCHEMAS else self.spark.read
        return reduce(DataFrame.unionByName, [reader.parquet(x) for x in folders]), after

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (url, version, ...) of the log that no later version has replaced."""
        gone, _ = self._log("gone")
        return rows.join(gone.select("url", "version"), ["url", "version"], "left_anti")

    def read(self, name: str) -> DataFrame | None:
        """A table as it stands; None where there is none."""
        if name not in self.LOG:
            v = self.versions(name)
            return self.spark.read.parquet(f"{self.folder}/{name}/v{v[-1]}") if v else None
        rows, after = self._log(name)
        if rows is None:
            return None
        if name == "docs":
            return self._alive(rows).drop("version")
        if name == "postings":
            return self._alive(rows)
        keys, count = (["token"], "df") if name == "token_df" else (["token", "neighbor"], "n")
        if name == "token_pairs":  # each pair lies under both of its tokens
            rows = rows.where("token < neighbor")
        out = rows.groupBy(*keys).agg(F.sum("d").cast("long").alias(count)).where(F.col(count) > 0)
        return out.withColumnsRenamed({"token": "t1", "neighbor": "t2"}) if name == "token_pairs" else out

    def _put(self, name: str, df: DataFrame, at: str) -> None:
        to = df.write.mode("overwrite")
        if name in self.SCHEMAS:
            to = df.withColumn("bucket", bucket("token")).repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.mode("overwrite").partitionBy("bucket")
        to.parquet(f"{self.folder}/{name}/{at}")

    def write(self, name: str, df: DataFrame, keep: int = 2) -> None:
        """The next version of a small table."""
        v = self.versions(name)
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{v[-1] + 1 if v else 0}")
        fs, path = self._fs()
        for old in v[:-keep] if keep else v:
            fs.delete(path(f"{self.folder}/{name}/v{old}"), True)

    def replace(self, name: str, df: DataFrame) -> None:
        """A stop list, taxonomy or fact table as a whole."""
        self.write(name, df)

    def put(self, name: str, df: DataFrame, key: str) -> None:
        """Dictionary entries, cards: rows by key."""
        old = self.read(name)
        self.write(name, df.dropDuplicates([key]) if old is None else upserted(old, df, key))

    def add_stops(self, words: Iterable[str]) -> None:
        held = self.read("stoplist")
        more = self.spark.createDataFrame([(w.lower(),) for w in words], "token string")
        self.replace("stoplist", (more if held is None else held.select("token").union(more)).distinct())

    def remove_stops(self, words: Iterable[str]) -> None:
        if (held := self.read("stoplist")) is not None:
            self.replace("stoplist", held.where(~F.col("token").isin(sorted(w.lower() for w in words))))

    def view(self, name: str) -> DataFrame | None:
        """A small table; None where it is missing or empty."""
        df = self.read(name)
        return None if df is None or df.isEmpty() else df

    def listing(self, name: str, column: str) -> DataFrame | None:
        """The distinct values of a column of a small table, in order."""
        df = self.view(name)
        return None if df is None else df.select(column).distinct().orderBy(column)

    def cards(self, period: str, k: int = 10) -> DataFrame | None:
        df = self.read("cards")
        return None if df is None else df.where(F.col("period") == period).orderBy(F.desc("id")).limit(k if k > 0 else 10)

    def document(self, doc_id: int | None = None, url: str | None = None) -> DataFrame | None:
        """The one document of an id or a url; the filter reaches the scan."""
        docs = self.read("docs")
        return None if docs is None else docs.where(F.col("doc_id") == doc_id if url is None else F.col("url") == url)

    def _under(self, name: str, tokens: list[str]) -> DataFrame | None:
        """The rows of some tokens; other buckets aren't read."""
        rows, _ = self._log(name)
        if rows is None:
            return None
        of = self.spark.createDataFrame([(t,) for t in tokens], "t string").select(bucket("t"))
        return rows.where(F.col("bucket").isin(sorted({r[0] for r in of.collect()})) & F.col("token").isin(tokens))

    def pairs(self, tokens: list[str]) -> DataFrame | None:
        """(token, neighbor, n) of a query's tokens with all others."""
        rows = self._under("token_pairs", tokens)
        return None if rows is None else rows.groupBy("token", "neighbor").agg(F.sum("d").cast("long").alias("n")).where("n > 0")

    def frequencies(self, tokens: list[str]) -> DataFrame | None:
        """(token, df) of some tokens."""
        rows = self._under("token_df", tokens)
        return None if rows is None else rows.groupBy("token").agg(F.sum("d").cast("long").alias("df")).where("df > 0")

    def holding(self, tokens: list[str]) -> DataFrame | None:
        """(token, url, doc_id, published_at) of the documents that hold one of the tokens."""
        rows = self._under("postings", tokens)
        return None if rows is None else self._alive(rows).select("token", "url", "doc_id", "published_at")

    def ingest(self, batch: DataFrame, order: str | None = "published_at", version: int | None = None) -> None:
        """Documents by url: the last of the batch counts, the statistics of what it replaces are taken back.

        A version that is committed already is a repeated batch and changes nothing."""
        done = self.committed()
        v = version if version is not None else (done[-1] + 1 if done else 0)
        if done and v <= done[-1]:
            return
        last = stored(upserted(batch.limit(0), batch, "url", order))
        log, _ = self._log("docs")
        if log is None:
            gone = last.limit(0).withColumn("version", F.lit(v).cast("long"))
        else:
            gone = stored(self._alive(log).join(last.select("url"), "url", "left_semi").select(*last.columns, "version"))
        self._put("docs", last.withColumn("version", F.lit(v).cast("long")), f"v{v}")
        self._put("gone", gone.select("url", "version"), f"v{v}")
        df, both = deltas(gone, last)
        self._put("token_df", df, f"v{v}")
        ends = F.array(F.struct(F.col("t1").alias("token"), F.col("t2").alias("neighbor")), F.struct(F.col("t2").alias("token"), F.col("t1").alias("neighbor")))
        self._put("token_pairs", both.select(F.explode(ends).alias("x"), "d").select("x.*", "d"), f"v{v}")
        stamp = F.col("published_at") if "published_at" in last.columns else F.lit(None).cast("timestamp")
        held = members(last.withColumn("__p", stamp).withColumn("__i", F.col("doc_id") if "doc_id" in last.columns else F.xxhash64("url")), "url", "tokens", "__i", "__p")
        self._put("postings", held.select("token", F.col("doc_id").alias("url"), F.col("__i").cast("long").alias("doc_id"), F.col("__p").cast("timestamp").alias("published_at"), F.lit(v).cast("long").alias("version")), f"v{v}")
        self._mark(f"v{v}")
        if len(self._log("gone")[1]) >= COMPACT:
            self.compact()

    def _mark(self, name: str) -> None:
        fs, path = self._fs()
        fs.create(path(f"{self.folder}/commits/{name}/_SUCCESS"), True).close()

    def compact(self) -> None:
        """Folds the log into a base; the folders before it go when the next base is there, so open readers end well."""
        done = self.committed()
        if not done:
            return
        v, older = done[-1], self.versions("commits", "base")
        if older and older[-1] == v:
            return
        docs, _ = self._log("docs")
        postings, _ = self._log("postings")
        df, _ = self._log("token_df")
        both, _ = self._log("token_pairs")
        self._put("docs", self._alive(docs), f"base{v}")
        self._put("postings", self._alive(postings).select("token", "url", "doc_id", "published_at", "version"), f"base{v}")
        self._put("token_df", df.groupBy("token").agg(F.sum("d").cast("long").alias("d")).where("d <> 0"), f"base{v}")
        self._put("token_pairs", both.groupBy("token", "neighbor").agg(F.sum("d").cast("long").alias("d")).where("d <> 0"), f"base{v}")
        self._put("gone", docs.select("url", "version").limit(0), f"base{v}")
        self._mark(f"base{v}")
        fs, path = self._fs()
        for name in self.LOG:
            for x in [x for x in self.versions(name) if older and x <= older[-1]]:
                fs.delete(path(f"{self.folder}/{name}/v{x}"), True)
            for x in [x for x in self.versions(name, "base") if older and x < older[-1]]:
                fs.delete(path(f"{self.folder}/{name}/base{x}"), True)


def follow(stream: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, **trigger):
    """Starts the stream that ingests each micro-batch; the batch number is the version, so a replay changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, n: store.ingest(prepare(df), version=n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def trends(stream: DataFrame, at: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, token, n): token counts by tumbling window of the event time; late rows beyond the watermark go."""
    return stream.withWatermark(at, late).select(at, F.explode(F.array_distinct("tokens")).alias("token")).groupBy(F.window(at, every), "token").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "token", "n")


def cleaned(docs: DataFrame, tokens, cats=None) -> DataFrame:
    """Documents whose tokens (or categories) change when the text pipeline runs again, with the new ones."""
    new = docs.withColumn("__t", tokens)
    changed = ~F.col("tokens").eqNullSafe(F.col("__t"))
    if cats is not None:
        new = new.withColumn("__c", cats)
        changed = changed | ~F.col("cats").eqNullSafe(F.col("__c"))
    return new.where(changed).drop("tokens", *(["cats"] if cats is not None else [])).withColumnsRenamed({"__t": "tokens", "__c": "cats"})


def cleaner_counts(docs: DataFrame, tokens) -> DataFrame:
    """(processed, updated, errors) of a cleaning run."""
    return docs.select(F.col("text").isNull().alias("e"), (~F.col("tokens").eqNullSafe(tokens)).alias("u")).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("u") & ~F.col("e")).alias("updated"), F.count_if("e").alias("errors"))


