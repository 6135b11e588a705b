"""The engine as one object: ingest, search, tune, rebuild, over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.scores import Weights, association
from .operators import graph, search, signals, stats, tagging, tuning
from .runtime import cut, stored
from .sources import config
from .streaming.store import Store


@dataclass
class Options:
    weights: Weights = field(default_factory=Weights)
    normal: bool = True
    min_df: int = 5
    #: What approves of suggestions, by kind: stopwords, rules, taxonomy, entities.
    reviewers: dict[str, tuning.Reviewer] = field(default_factory=dict)
    #: Most stop words and dictionary entries that the text pipeline holds; more is an error.
    most_stops: int = 100_000
    most_entries: int = 1_000_000


FACTS = "relation string, subject string, object string"


class Engine:
    """components: stop list, taxonomy, phrases, synonyms; facts: (relation, subject, object) rows."""

    def __init__(self, spark: SparkSession, folder: str, components: config.Components | None = None, facts: DataFrame | None = None, options: Options | None = None):
        self.spark, self.store = spark, Store(spark, folder)
        self.components = components or config.Components()
        self.options = options or Options()
        rules = self.components.rules_path
        if facts is None and rules:
            with open(rules) as lines:
                facts = config.facts(spark, config.rules(lines))
        kept = self.store.read("facts")
        self.facts = facts if facts is not None else spark.createDataFrame([], FACTS)
        if kept is not None:
            self.facts = graph.with_facts(self.facts, kept)

    def rebuild(self) -> None:
        """The text pipeline from the stored stop list, dictionary and taxonomy, where there are any."""

        def held(name: str, most: int, order: str):
            df = self.store.view(name)
            rows = [] if df is None else df.orderBy(order).limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} rows of {name}")
            return rows

        if stops := held("stoplist", self.options.most_stops, "token"):
            self.components.stops = [r["token"] for r in stops]
        if words := held("dict", self.options.most_entries, "phrase"):
            self.components.phrases = [(r["canonical"], [r["phrase"]], r["category"]) for r in words]
        if names := held("taxonomy", self.options.most_entries, "name"):
            self.components.taxonomy = {k: {} for k in ("sectors", "events", "regions", "entities")}
            for r in names:
                under = self.components.taxonomy[r["kind"]]
                if r["kind"] == "entities":
                    under = under.setdefault(r["type"], {})
                under.setdefault(r["name"], []).append(r["keyword"])

    def set_taxonomy(self, taxonomy: dict) -> None:
        """Stores a taxonomy (kind -> name -> keywords; entities: type -> name -> keywords) and uses it."""
        rows = [(kind, None, name, str(k)) for kind in ("sectors", "events", "regions") for name, ks in (taxonomy.get(kind) or {}).items() for k in ks]
        rows += [("entities", type_, name, str(k)) for type_, names in (taxonomy.get("entities") or {}).items() for name, ks in names.items() for k in ks]
        self.store.replace("taxonomy", self.spark.createDataFrame(rows, "kind string, type string, name string, keyword string"))
        self.components.taxonomy = taxonomy

    def add_facts(self, more: DataFrame) -> None:
        """Facts that stay after a restart."""
        self.facts = stored(graph.with_facts(self.facts, more))
        self.store.replace("facts", self.facts)

    def prepared(self, items: DataFrame) -> DataFrame:
        """Items (url, title, outlet, published_at, text, source_cats) as documents."""
        c = self.components
        phrases = tagging.Phrases((a, b) for a, b, _ in c.phrases) if c.phrases else None
        out = tagging.processed(items, F.col("text"), c.stops, c.lexicon.canonical, phrases, c.taxonomy, c.taxonomy.get("entities"))
        cats = F.array_union(F.coalesce("source_cats", F.array().cast("array<string>")), "cats")
        links = F.col("links_out") if "links_out" in items.columns else F.lit(0)
        return out.select("url", F.xxhash64("url").alias("doc_id"), "title", "outlet", "published_at", "tokens", text.distinct_words(cats).alias("cats"), "ents", links.cast("int").alias("links_out"), "text")

    def ingest(self, items: DataFrame) -> None:
        self.store.ingest(self.prepared(items))

    def docs(self) -> DataFrame:
        found = self.store.read("docs")
        if found is None:
            raise ValueError("nothing has been ingested")
        return found

    def query(self, words: str) -> DataFrame:
        """One row: query_id, tokens, cats, wanted."""
        q = self.prepared(self.spark.createDataFrame([("query", words)], "url string, text string").withColumns({"title": F.lit(""), "outlet": F.lit(""), "published_at": F.lit(None).cast("timestamp"), "source_cats": F.array().cast("array<string>")}))
        q = cut(q.select(F.lit(0).cast("long").alias("query_id"), text.distinct_words(F.col("tokens")).alias("tokens"), "cats"))
        more = graph.expand(self.facts, q.select("query_id", F.explode("tokens").alias("token"))).groupBy("query_id").agg(F.sort_array(F.collect_list("token")).alias("m"))
        return cut(q.join(more, "query_id", "left").select("query_id", "tokens", "cats", F.array_distinct(F.concat("tokens", F.coalesce("m", F.array().cast("array<string>")))).alias("wanted")))

    def _ranked(self, words: str, k: int, now: datetime | None) -> tuple[DataFrame, DataFrame]:
        o, q = self.options, self.query(words)
        return q, search.top_k(search.from_store(self.store, q, now or datetime.now(timezone.utc), k, o.weights, o.normal, o.min_df), k)

    def search(self, words: str, k: int = 3, now: datetime | None = None) -> DataFrame:
        """The k best documents with their score parts."""
        return self._ranked(words, k, now)[1]

    def cards(self, words: str, k: int = 3, now: datetime | None = None) -> DataFrame:
        """One explained card for each of the k best documents, the best first."""
        q, ranked = self._ranked(words, k, now)
        return search.cards(ranked, self.docs(), q, text.card_id(F.lit(words), F.col("doc_id").cast("string"))).drop("query_id", "doc_id").orderBy("rank")

    def signals(self, words: str, k: int = 3, now: datetime | None = None) -> dict[str, DataFrame]:
        """Collisions, prediction error and token damping of a search, from the stored pair counts of the query's tokens."""
        q, ranked = self._ranked(words, k, now)
        return signals.bundle(q, cut(ranked.select("query_id", "doc_id")), self.docs().select("doc_id", "tokens"), self.pairs_of(q))

    def pairs_of(self, queries: DataFrame) -> DataFrame:
        """Scored pairs of the queries' tokens with others of min_df documents, from the store's counts."""
        asked = sorted({t for r in queries.select("tokens").collect() for t in r["tokens"]})
        df = self.store.read("token_df")
        one, two = (df.where(F.col("df") >= self.options.min_df).select(F.col("token").alias(f"t{k}"), F.col("df").alias(f"df{k}")) for k in (1, 2))
        held = self.store.pairs(asked).select(F.least("token", "neighbor").alias("t1"), F.greatest("token", "neighbor").alias("t2"), "n").distinct()
        n = self.docs().count()
        return stored(held.join(one, "t1").join(two, "t2").select("t1", "t2", "n", "df1", "df2").withColumn("score", association(F.col("n"), F.col("df1"), F.col("df2"), F.lit(n), self.options.normal)))

    def tune(self, rounds: int = 3, thresholds: tuning.StopThresholds = tuning.StopThresholds(entropy=-1.0), confidence: float = 0.6, least: float = 0.8, support: int = 5) -> dict[str, DataFrame]:
        """Stop words, rules, taxonomy drift and entities from the stored documents, each as its reviewer approves.

        Stop words and rules are kept; rules become facts, and dictionary entries whose category is the relation."""
        docs, o = self.docs(), self.options
        ask = o.reviewers.get
        found, _ = tuning.rounds(docs, thresholds, rounds, reviewer=ask("stopwords"))
        found = stored(found)
        base = self.spark.createDataFrame([(s,) for s in self.components.stops], "token string")
        stops = stored(base.union(found.select("token")).distinct())
        self.store.replace("stoplist", stops)
        n, occ = docs.count(), stats.members(docs)
        df = stored(stats.without_tokens(stats.frequencies(occ), found, "token"))
        rules = stored(tuning.tuned_rules(stats.scored(stats.pairs(occ, df, support), n, o.normal), least, support, confidence, ask("rules")))
        self.add_facts(rules.select("relation", "subject", "object"))
        phrase = F.concat_ws(" ", "subject", "object")
        entries = rules.select(phrase.alias("phrase"), phrase.alias("canonical"), F.col("relation").alias("category"))
        if not entries.isEmpty():
            self.store.put("dict", entries, "phrase")
        keywords = tagging.keyword_table(self.spark, self.components.taxonomy)
        drift = tuning.tuned_taxonomy(df, n, keywords, stops, stats.token_categories(docs, F.col("cats")), 0.0, ask("taxonomy"))
        each = docs.select(F.explode("ents").alias("e")).groupBy("e.type", "e.value").agg(F.count(F.lit(1)).alias("occurrences"))
        entities = tuning.tuned_entities(each.withColumn("confidence", 1 - F.exp(-F.col("occurrences") / 10.0)), reviewer=ask("entities"))
        return {"stopwords": found, "rules": rules, "taxonomy": drift, "entities": entities}


def prompt(card: dict, question: str) -> str:
    """What a language model is asked to summarise; calling one is up to the caller."""
    lines = [f"- {b} ({s['url']})" for b, s in zip(card["bullets"], card["sources"])]
    return "\n".join([f"Question: {question}", "Sources:", *lines, "Answer from the sources alone."])


def together(cards: list[dict]) -> dict:
    """The bullets and sources of several cards as those of one."""
    return {"bullets": [b for c in cards for b in c["bullets"]], "sources": [s for c in cards for s in c["sources"]]}


def summarised(cards: list[dict], question: str, ask: Callable[[str], str]) -> list[str]:
    return [ask(prompt(c, question)) for c in cards]
