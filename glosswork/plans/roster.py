"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import bootstrap, graph, packed, search, signals, stats, tagging, tuning
from ..sources import corpus as sources
from ..sources.corpus import table
from ..streaming import store

STOPS = ("the", "and", "of", "der", "die", "und", "le", "la", "des", "el", "los", "que")
SYNONYMS = {"is": "be", "was": "be", "are": "be", "ist": "sein", "est": "etre", "es": "ser"}
TAXONOMY = {"sectors": {"english": ["the", "of", "that"], "german": ["der", "und", "nicht"]}, "events": {"french": ["le", "dans", "pour"], "english": ["with"]}, "regions": {"spanish": ["el", "los", "para"], "stale": ["dinosaur", "sushi"]}, "entities": {"ending": {"tion": ["tion"], "ung": ["ung ", "heit"]}, "mark": {"mail": ["@"], "licence": ["license", "copyright"]}}}
PHRASES = [("of the", ["of the"]), ("in the", ["in the"]), ("de la", ["de la", "de las"]), ("that is", ["that is", "that was"])]
FACTS = [("is_a", "gpt", "transformer"), ("is_a", "transformer", "neural-network"), ("is_a", "neural-network", "model"), ("used_for", "gpt", "text"), ("used_for", "text", "search"), ("related_to", "model", "data"), ("related_to", "data", "corpus"), ("related_to", "corpus", "data"), ("related_to", "corpus", "text"), ("related_to", "that", "with"), ("related_to", "with", "for")]
NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
#: Documents that a rule, a linked pair or an edge of a cluster needs (the tuners' and the bootstrap's own thresholds).
SUPPORT, SYNONYM_SUPPORT, SYNONYM_SCORE = 5, 3, 0.3
STOP = tuning.StopThresholds(df_percent=15.0, pmi_max=0.6, entropy=-1.0, bootstrap_df_percent=15.0)
MODES = ("view", "click", "purchase")


def _docs(spark: SparkSession, sf: str, stops=(), only: DataFrame | None = None) -> DataFrame:
    """only: (doc_id) of the documents to be read; those that are left out aren't cut into tokens."""
    d = table(spark, sf, "documents")
    d = sources.as_docs(d if only is None else d.join(only, "doc_id", "left_semi"))
    return d.withColumn("tokens", text.tokens(F.col("text"), stops))


def _stats(spark: SparkSession, sf: str, stops=()) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """corpus, documents, members, frequencies."""
    d = stats.cut(_docs(spark, sf, stops))
    occ = stats.members(d)
    return d, d.count(), occ, stats.frequencies(occ)


def _r(name: str):
    return F.round(name, 6).alias(name)


def tokenize_clean(spark, sf):
    return _docs(spark, sf, STOPS).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def lexicon_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text"), STOPS, SYNONYMS).alias("tokens"))
    return d.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def clean_text_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.squeezed(text.without_links(F.col("html"))).alias("clean"))


def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.stripped_html(F.col("html")).alias("stripped"))


def categorize_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.labelled(F.concat_ws(" ", "url", "html"), sources.TOPICS, "tech"), ",").alias("topics"))


def category_codes(spark, sf):
    return table(spark, sf, "events").select(text.coded(F.concat("event_type", F.lit("."), F.col("user_id").cast("string")), {"view": "look", "purchase.1": "first-buyers"}).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def story_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.shortened(text.story_title(F.col("text")), 80).alias("title"))


def doc_validity(spark, sf):
    d = sources.as_docs(table(spark, sf, "documents")).withColumn("title", text.story_title(F.col("text")))
    return d.groupBy("outlet").agg(F.count_if(sources.valid()).alias("valid"), F.count(F.lit(1)).alias("n"))


def doc_frequency(spark, sf):
    _, n, _, df = _stats(spark, sf)
    return stats.frequency_stats(df, n).select("token", "df", _r("df_percent"), _r("idf"))


def high_df_tokens(spark, sf):
    _, n, _, df = _stats(spark, sf)
    return stats.frequency_stats(df, n).select("token", "df", _r("df_percent")).orderBy(F.desc("df"), "token").limit(20)


def bigram_counts(spark, sf):
    return stats.bigrams(_docs(spark, sf))


def skipgram_counts(spark, sf):
    return stats.skipgrams(_docs(spark, sf))


def doc_pair_counts(spark, sf):
    """All pairs of all tokens, summed up for each token: partners, documents shared with them, the most with one."""
    p, _ = packed.pack(_docs(spark, sf))

    def sums(p, left, ends, j, n):
        n = n.astype("int64")
        return packed.batch(token=p.names(left), partners=packed.counts(ends), joint=packed.over(np.add, n, ends), most=packed.over(np.maximum, n, ends))

    return packed.rows(spark, p, sums, "token string, partners long, joint long, most long")


def pmi_pairs(spark, sf):
    """All pairs of all tokens, raw scores: the highest and the lowest of each token, and how many are above 0."""
    p, _ = packed.pack(_docs(spark, sf))

    def sums(p, left, ends, j, n):
        s = packed.scores(p, False).rows(left, ends, j, n)
        high, low = packed.over(np.maximum, s, ends), packed.over(np.minimum, s, ends)
        return packed.batch(token=p.names(left), highest=high, lowest=low, above=packed.over(np.add, (s > 1e-9).astype("int64"), ends))

    return packed.rows(spark, p, sums, "token string, highest double, lowest double, above long").select("token", *[(_r(c) + 0.0).alias(c) for c in ("highest", "lowest")], "above")


def _supported(spark, sf, score: float | None = None):
    """t1, t2, n, score of the pairs of the support that rules need, of all tokens."""
    p, _ = packed.pack(_docs(spark, sf), SUPPORT)
    return packed.rows(spark, p, packed.supported(SUPPORT, score), packed.SUPPORTED, half=True)


def npmi_pairs(spark, sf):
    """The pairs of the support that rules need, of all tokens."""
    return _supported(spark, sf).select("t1", "t2", "n", _r("score"))


def basket_npmi(spark, sf):
    d = stats.cut(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("tokens")))
    occ, n = stats.members(d), d.count()
    return stats.scored(stats.pairs(occ, stats.frequencies(occ)), n).select("t1", "t2", "n", _r("score"))


def event_pair_npmi(spark, sf):
    d = stats.cut(table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.collect_set("event_type").alias("tokens")))
    occ, n = stats.members(d), d.count()
    return stats.scored(stats.pairs(occ, stats.frequencies(occ)), n).select("t1", "t2", "n", _r("score"))


def top_neighbors(spark, sf):
    p, _ = packed.pack(_docs(spark, sf), SUPPORT)
    return packed.rows(spark, p, packed.nearest(10), packed.NEAREST).select("token", "neighbor", "n", _r("score"), "rank")


def phrase_pairs(spark, sf):
    """The 200 best of all bigrams. No pair scores above 1, so a phrase scores at most what its bigrams count: the most
    frequent bigrams are scored, and more of them until none that is left could be among the best."""
    best, least = 200, 0.01
    d = stats.stored(_docs(spark, sf).select("tokens"))
    counted = tuning.Counted(d)
    factors = stats.stored(counted.named(counted.factors().select("token", "factor")))
    seen = stats.stored(stats.bigrams(d).where("a <> b"))
    many = stats.stored(seen.groupBy("n").agg(F.count(F.lit(1)).alias("k")))
    floors = many.select("n", F.sum("k").over(Window.orderBy(F.desc("n"))).alias("k"))
    most = 20_000
    while True:
        at = floors.where(F.col("k") <= most).agg(F.min("n")).first()[0]
        at = at if at is not None else many.agg(F.max("n")).first()[0] or 1
        some = stats.stored(seen.where(F.col("n") >= at))
        found = stats.damped(tuning.pairs_of(counted, some.select(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2")).distinct()), factors)
        out = stats.stored(stats.phrase_pairs(some, found, least, best))
        last = out.agg(F.count(F.lit(1)), F.min("phrase_score")).first()
        if at <= 1 or last[0] == best and last[1] > at - 1 + 1e-5:
            return out.select("a", "b", _r("score"), "bigrams", "support", _r("phrase_score"))
        most *= 16


def linked_tokens(spark, sf):
    return _linked(spark, sf, SUPPORT).where("score > 0.1").select("a", "b", "n", _r("score"))


def _linked(spark, sf, support: int):
    """a, b, n, score of the skip-gram pairs of that support."""
    links, n = packed.skip_links(_docs(spark, sf), support)
    return stats.scored(links, n).select("a", "b", "n", "score")


def token_categories(spark, sf):
    return stats.token_categories(_docs(spark, sf), F.col("source_cats"))


def token_category_entropy(spark, sf):
    return stats.entropies(stats.token_categories(_docs(spark, sf), F.array("outlet"))).select("token", (F.round("entropy", 6) + 0.0).alias("entropy"))


def damping_factors(spark, sf):
    counted = tuning.Counted(_docs(spark, sf))
    return counted.named(counted.factors().select("token", "neighbors", "factor")).select("token", "neighbors", _r("factor"))


def stopword_stats(spark, sf):
    counted = tuning.Counted(_docs(spark, sf), F.col("source_cats"))
    return counted.named(counted.rows(None)).select("token", "df", _r("df_percent"), _r("idf"), _r("pmi_max"), (F.round("entropy", 6) + 0.0).alias("entropy"))


def stopword_candidates(spark, sf):
    counted = tuning.Counted(_docs(spark, sf), F.col("source_cats"))
    return counted.named(tuning.stop_candidates(counted.rows(None), STOP)).select("token", "df", _r("pmi_max"), (F.round("entropy", 6) + 0.0).alias("entropy"), "bootstrap", _r("score"))


def _rules(spark, sf):
    return tuning.rules(_supported(spark, sf, 0.5), 0.5, SUPPORT)


def rule_suggestions(spark, sf):
    return _rules(spark, sf).where("confidence >= 0.6").select("relation", "subject", "object", _r("score"), "support", _r("confidence"))


def rule_export(spark, sf):
    return tuning.rule_lines(_rules(spark, sf))


def taxonomy_assign(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.array_join(tagging.categories(F.col("tokens"), TAXONOMY), ",").alias("cats"))


def entity_extract(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(tagging.entities(F.col("text"), TAXONOMY["entities"])).alias("e")).select("doc_id", "e.type", "e.value")


def taxonomy_drift(spark, sf):
    d, n, _, df = _stats(spark, sf)
    df = stats.cut(df)
    stops = spark.createDataFrame([(s,) for s in STOPS], "token string")
    out = tuning.drift(df, n, tagging.keyword_table(spark, TAXONOMY), stops, stats.token_categories(d, F.col("source_cats")))
    return out.select("kind", "category", "token", "support", _r("share"), _r("confidence"))


def entity_suggestions(spark, sf):
    n = F.count(F.lit(1))
    seen = entity_extract(spark, sf).groupBy("type", "value").agg(n.alias("occurrences"), (1 - F.exp(-n / 10.0)).alias("confidence"))
    return tuning.entity_suggestions(seen).select("type", "value", "occurrences", _r("confidence"))


def jaccard_categories(spark, sf):
    d = _docs(spark, sf)
    wanted = F.array(*map(F.lit, ("english", "french")))
    return d.select("doc_id", F.round(text.jaccard(tagging.categories(F.col("tokens"), TAXONOMY), wanted).cast("double"), 6).alias("similarity"))


def _queries(spark, sf, one: bool) -> DataFrame:
    b = table(spark, sf, "benchmark")
    if one:
        b = b.orderBy("item_id").limit(1)
    q = b.select(F.col("item_id").alias("query_id"), text.distinct_words(text.tokens(F.col("text"))).alias("tokens"))
    return stats.cut(q.withColumn("cats", tagging.categories(F.col("tokens"), TAXONOMY)))


def _expanded(spark, q: DataFrame) -> DataFrame:
    """Queries with wanted: their tokens and what the facts lead to."""
    facts = spark.createDataFrame(FACTS, "relation string, subject string, object string")
    more = graph.expand(facts, q.select("query_id", F.explode("tokens").alias("token"))).groupBy("query_id").agg(F.array_sort(F.collect_list("token")).alias("__m"))
    return stats.cut(q.join(more, "query_id", "left").withColumn("wanted", F.array_distinct(F.concat("tokens", F.coalesce("__m", F.array().cast("array<string>"))))).drop("__m"))


def _searched(spark, sf, one: bool):
    """(indexed documents, queries, score parts of their candidates)"""
    index = search.indexed(_docs(spark, sf).withColumn("cats", tagging.categories(F.col("tokens"), TAXONOMY)))
    q = _expanded(spark, _queries(spark, sf, one))
    return index, q, search.breakdown(index, q, NOW)


PARTS = ("pmi", "cats", "recency", "authority", "length", "damping", "total")


def inverted_index_lookup(spark, sf):
    q = _queries(spark, sf, False)
    return search.candidates(_docs(spark, sf), q, 20, "tokens").select("query_id", "doc_id")


def score_breakdown(spark, sf):
    return _searched(spark, sf, False)[2].select("query_id", "doc_id", *map(_r, PARTS))


def search_topk(spark, sf):
    return search.top_k(_searched(spark, sf, True)[2]).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), *map(_r, PARTS))


def batch_search(spark, sf):
    return search.top_k(_searched(spark, sf, False)[2]).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), _r("total"))


def retrieve_with_neighbors(spark, sf):
    q = _queries(spark, sf, False)
    d = stats.stored(_docs(spark, sf).select("doc_id", "published_at", F.array_distinct("tokens").alias("tokens")))
    p, _ = packed.pack_sets(d, SUPPORT, "tokens")
    return search.with_neighbors(d, q, _near(spark, p, q, 10)[0])


def _near(spark, p, q, k: int):
    """(the k nearest of each query token among the tokens that the neighbours' floor admits, a mask of the query tokens
    that it admits)."""
    most, asked = packed.admitted(p, _asked(q), SUPPORT)
    return stats.stored(packed.rows(spark, p, packed.nearest(k), packed.NEAREST, only=asked, head=most)), asked


def _asked(q: DataFrame) -> DataFrame:
    return stats.stored(q.select(F.explode("tokens").alias("token")).distinct())


def cards(spark, sf):
    _, q, s = _searched(spark, sf, False)
    ranked = stats.stored(search.top_k(s))
    d = _docs(spark, sf, only=ranked.select("doc_id").distinct())
    d = d.select("doc_id", text.story_title(F.col("text")).alias("title"), "url", "published_at", "tokens")
    out = search.cards(ranked, d, q, text.card_id(F.col("query_id").cast("string"), F.col("doc_id").cast("string")))
    show = lambda c: F.array_join(c, "|")
    parts = [F.round(F.col("breakdown")[p], 6).alias(p) for p in ("pmi", "cats", "recency", "authority", "length")]
    return out.select("id", "query_id", F.col("rank").cast("long").alias("rank"), "title", show(F.col("bullets")).alias("bullets"), show(F.transform("sources", lambda x: x["url"])).alias("urls"), show(F.col("matched")).alias("matched"), show(F.col("category_overlap")).alias("category_overlap"), show(F.col("expanded")).alias("expanded"), *parts)


def collisions(spark, sf):
    q = _queries(spark, sf, False)
    p, _ = packed.pack(_docs(spark, sf), SUPPORT)
    near, asked = _near(spark, p, q, 1)
    strengths = stats.stored(q.select("query_id", F.posexplode("tokens").alias("pos", "token")).join(near.select("token", F.col("score").alias("strength")), "token"))
    met = packed.among(p, strengths.select("query_id", "token"))
    joint = stats.stored(packed.rows(spark, p, met, packed.SUPPORTED, half=True, only=asked))
    return signals.collisions(strengths, joint).select("query_id", "a", "b", _r("strength_a"), _r("strength_b"), _r("joint"), _r("surprise"))


def _signals(spark, sf, k: int):
    """queries, their top documents, the tokens of these, and the k nearest of each query token."""
    index, q, s = _searched(spark, sf, False)
    ranked = stats.stored(search.top_k(s).select("query_id", "doc_id"))
    d = stats.stored(index.docs.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "tokens"))
    return q, ranked, d, _near(spark, index.packed, q, k)[0]


def prediction_error(spark, sf):
    q, ranked, d, near = _signals(spark, sf, 10)
    return signals.prediction_error(near, q, ranked, d).select("query_id", "predicted", "actual", "shared", "missing", "unexpected", _r("error"))


def token_damping(spark, sf):
    q, ranked, d, near = _signals(spark, sf, 500)
    sizes = signals.found_tokens(ranked, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return signals.token_density(near, q, sizes).select("query_id", "token", "neighbors", _r("factor"))


def _facts(spark, sf):
    r = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = r.select(F.lit("is_a").alias("relation"), F.col("n_name").alias("subject"), F.col("r_name").alias("object")).union(r.select(F.lit("is_a"), "r_name", F.lit("WORLD")))
    return graph.with_facts(spark.createDataFrame(FACTS, "relation string, subject string, object string"), geo)


def fact_closure(spark, sf):
    return graph.closure(_facts(spark, sf))


def facts_provable(spark, sf):
    names = _facts(spark, sf).select(F.explode(F.array("subject", "object")).alias("x")).distinct()
    asked = names.select(F.explode(F.array(*map(F.lit, graph.PROVEN))).alias("relation"), F.col("x").alias("subject")).crossJoin(F.broadcast(spark.createDataFrame([("WORLD",), ("corpus",), ("search",)], "object string")))
    return graph.provable(_facts(spark, sf), asked)


def expand_tokens(spark, sf):
    q = _facts(spark, sf).select(F.col("subject").alias("query_id"), F.col("subject").alias("token")).distinct()
    return graph.expand(_facts(spark, sf), q)


def neighbors_undirected(spark, sf):
    return graph.undirected(_facts(spark, sf))


def proof_path(spark, sf):
    """The proof of everything that can be proven from the facts of the tables and the literal ones."""
    return graph.proofs(_facts(spark, sf)).select("subject", "object", F.col("depth").cast("long").alias("depth"), "relation", "source", "target")


def phrase_parse(spark, sf):
    p = tagging.Phrases(PHRASES)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return _docs(spark, sf).select("doc_id", p.column(F.col("tokens")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda x: x.contains(" "))).cast("long").alias("n_phrases"))


def clusters(spark, sf):
    p, _ = packed.pack(_docs(spark, sf), SUPPORT)
    e = packed.forest(packed.rows(spark, p, packed.linked(SUPPORT, 0.5), "a long, b long", half=True), parts=4 * spark.sparkContext.defaultParallelism)
    named = packed.named(p, graph.components(e))
    return graph.grouped(named).select("root", F.array_join("tokens", ",").alias("tokens"), "size")


def synonym_groups(spark, sf):
    e = stats.cut(_linked(spark, sf, SYNONYM_SUPPORT).where(F.col("score") >= SYNONYM_SCORE))
    return graph.synonym_groups(e).select("canonical", F.array_join("variants", ",").alias("variants"), _r("score"), "support")


def keyword_candidates(spark, sf):
    _, n, _, df = _stats(spark, sf)
    return bootstrap.keywords(df, n, STOPS).select("token", "df", _r("df_percent"))


def _versions(spark, sf, often: bool = False):
    """Documents as first stored, and again without stop words where the id is divisible by 3 (a changed text); often:
    they are read several times, so their tokens are made once and stored."""
    d = _docs(spark, sf).select("doc_id", "url", "tokens")
    d = stats.stored(d) if often else d
    return d, d.where(F.col("doc_id") % 3 == 0).withColumn("tokens", F.filter("tokens", lambda x: ~x.isin(*STOPS)))


def reingest_deltas(spark, sf):
    old, new = _versions(spark, sf, True)
    change, _ = store.deltas(old.join(new.select("url"), "url", "left_semi").select(*new.columns), new)
    counts = stats.frequencies(stats.members(old))
    return store.merged(counts, change, ["token"], "df")


def document_upsert(spark, sf):
    old, new = _versions(spark, sf)
    return store.upserted(old, new, "url").select("url", "doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def prune_tokens(spark, sf):
    gone = spark.createDataFrame([(s,) for s in STOPS], "token string")
    return stats.without_tokens(stats.bigrams(_docs(spark, sf)), gone, "a", "b")


def autotune_rounds(spark, sf):
    out, _ = tuning.rounds(_docs(spark, sf), STOP, 3, F.col("source_cats"))
    return out.select(F.col("round").cast("long").alias("round"), "token", "df", _r("score"))


def bootstrap_rounds(spark, sf):
    _, report = bootstrap.run(_docs(spark, sf), STOPS, 3, STOP)
    rows = [(r["iteration"], w, r["total_stopwords"]) for r in report for w in r["new_stopwords"] or [None]]
    return spark.createDataFrame(rows, "iteration long, token string, total_stopwords long")


def cleaner_updates(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", "tokens")
    return store.cleaned(d, text.tokens(F.col("text"), STOPS)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def category_histogram(spark, sf):
    # the tokens have a projection of their own: inside the categories they would be made once for each of these
    d = table(spark, sf, "documents").select(text.tokens(F.col("text")).alias("tokens"))
    return d.select(F.explode(tagging.categories(F.col("tokens"), TAXONOMY)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def event_trends(spark, sf):
    e = table(spark, sf, "events").select("ts", F.array("event_type", F.get_json_object("props", "$.k").cast("string")).alias("tokens"))
    e = e.withColumn("tokens", F.filter("tokens", lambda x: x.isNotNull()))
    return e.select("ts", F.explode(F.array_distinct("tokens")).alias("token")).groupBy(F.window("ts", "1 hour").alias("w"), "token").agg(F.count(F.lit(1)).alias("n")).select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH").alias("hour"), "token", "n")


# SQL

TOK = r"list_filter(list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}-]+'), lambda x: regexp_replace(regexp_replace(lower(x), '^-+|-+$', '', 'g'), '-{{2,}}', '-', 'g')), lambda x: strlen(x) > 1 AND NOT regexp_full_match(x, '[\p{{Nd}}-]+'))"
ALL = TOK.format(t="text")


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


KEPT = f"list_filter({ALL}, lambda x: x NOT IN ({_list(STOPS)}))"
D = f"d AS MATERIALIZED (SELECT doc_id, source, lang, text, {ALL} AS toks FROM documents)"
U = f"{D}, u AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(toks) AS tok FROM d), nn AS (SELECT count(*) AS big_n FROM d), df AS MATERIALIZED (SELECT tok, count(*) AS df FROM u GROUP BY tok)"


def _npmi(n, a, b, big="big_n") -> str:
    return f"CASE WHEN {n} = 0 OR ln(({n} + 1e0) / {big}) = 0 THEN 0 ELSE ln((({n} + 1e0) * {big}) / (({a} + 1e0) * ({b} + 1e0))) / -ln(({n} + 1e0) / {big}) END"


def _pmi(n, a, b, big="big_n") -> str:
    return f"ln((({n} + 1e0) * {big}) / (({a} + 1e0) * ({b} + 1e0)))"


def _pairs(where: str, score=_npmi, least: int = 1, base: str = U + ", ") -> str:
    """v(tok, df, id), o, pn(i, j, n): pairs by number of the tokens that a condition admits; sc: scored."""
    return f"""{base}v AS MATERIALIZED (SELECT tok, df, row_number() OVER (ORDER BY tok)::INTEGER AS id FROM df, nn WHERE {where}), o AS MATERIALIZED (SELECT doc_id, id FROM u JOIN v USING (tok)),
pn AS MATERIALIZED (SELECT a.id AS i, b.id AS j, count(*)::INTEGER AS n FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= {least}),
sc AS MATERIALIZED (SELECT i, j, n, x.df AS df1, y.df AS df2, {score('n', 'x.df', 'y.df')} AS score FROM pn JOIN v x ON i = x.id JOIN v y ON j = y.id CROSS JOIN nn)"""


NAMES = "p AS MATERIALIZED (SELECT x.tok AS t1, y.tok AS t2, n, df1, df2, score FROM sc JOIN v x ON i = x.id JOIN v y ON j = y.id)"
NEAR_PAIRS = f"{_pairs(f'df >= {SUPPORT}')}, {NAMES}"
MORE_PAIRS = f"{_pairs(f'df >= {SUPPORT}', base='')}, {NAMES}"
SUPPORTED = f"{_pairs(f'df >= {SUPPORT}', least=SUPPORT)}, {NAMES}"
NEAR = "e AS MATERIALIZED (SELECT t1 AS token, t2 AS neighbor, n, score FROM p UNION ALL SELECT t2, t1, n, score FROM p), nx AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY round(score, 9) DESC, neighbor) AS rank FROM e) WHERE rank <= 500), near AS MATERIALIZED (SELECT * FROM nx WHERE rank <= 10)"


def _damp(ratio: str) -> str:
    t = f"(({ratio} - 0.3e0) / 0.3e0)"
    return f"CASE WHEN {ratio} <= 0.3e0 THEN 1e0 WHEN {ratio} >= 0.6e0 THEN 0.1e0 ELSE 1 - {t} * {t} * (3 - 2 * {t}) * 0.9e0 END"


def _hub(sc: str, v: str, f: str, q: str, scale: str = "") -> str:
    """Damping factors f(id, neighbors, factor) of the tokens v by the scored pairs sc, and damped pairs q(i, j, n, score)."""
    return f"""{f} AS MATERIALIZED (SELECT id, coalesce(neighbors, 0)::BIGINT AS neighbors, {_damp(f'(coalesce(neighbors, 0) / (SELECT count(*) FROM {v})::DOUBLE)')} AS factor
FROM {v} LEFT JOIN (SELECT id, sum(k) AS neighbors FROM (SELECT i AS id, count(*) AS k FROM {sc} WHERE score >= 0.05 GROUP BY i UNION ALL SELECT j, count(*) FROM {sc} WHERE score >= 0.05 GROUP BY j) GROUP BY id) USING (id)),
{q} AS (SELECT i, j, n, score * sqrt(a.factor * b.factor) AS score FROM {sc} JOIN {f} a ON i = a.id JOIN {f} b ON j = b.id)"""


def _most(q: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT id, greatest(0, max(m)) AS pmi_max FROM (SELECT i AS id, max(score) AS m FROM {q} GROUP BY i UNION ALL SELECT j, max(score) FROM {q} GROUP BY j) GROUP BY id)"


ALL_PAIRS = _pairs("TRUE")
HUBS = f"{ALL_PAIRS}, {_hub('sc', 'v', 'f', 'q')}"
BIGRAMS = "bg AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(list_slice(toks, 1, len(toks) - 1)) AS a, unnest(list_slice(toks, 2, len(toks))) AS b FROM d WHERE len(toks) > 1) GROUP BY a, b)"
SKIPS = """pos AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM d),
sk AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT x.doc_id, least(x.tok, y.tok) AS a, greatest(x.tok, y.tok) AS b FROM (SELECT p.doc_id, p.tok, p.i, unnest([1, 2, 3, 4]) AS k FROM pos p) x JOIN pos y ON x.doc_id = y.doc_id AND y.i = x.i + x.k WHERE x.tok <> y.tok) GROUP BY a, b)"""


def _entropy(cat: str) -> str:
    return f"""tc AS (SELECT tok, {cat} AS category, count(*) AS n FROM u JOIN (SELECT doc_id, source, lang FROM d) USING (doc_id) GROUP BY 1, 2),
en AS MATERIALIZED (SELECT tok, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*) + 1e0) AS entropy FROM tc GROUP BY tok)"""


def _rows(v: str, mx: str, en: bool) -> str:
    e = "coalesce(entropy, 0)" if en else "0e0"
    return f"SELECT id, tok AS token, df, 100e0 * df / big_n AS df_percent, ln(big_n::DOUBLE / (1 + df)) AS idf, coalesce(pmi_max, 0e0) AS pmi_max, {e} AS entropy FROM {v} CROSS JOIN nn LEFT JOIN {mx} USING (id)" + (" LEFT JOIN en USING (tok)" if en else "")


STOPROWS = f"{HUBS}, {_entropy('lang')}, {_most('q', 'mx')}, ss AS MATERIALIZED ({_rows('v', 'mx', True)})"
def _candidates(pmi_max="pmi_max", e="entropy", s=STOP) -> str:
    return f"CASE WHEN {pmi_max} = 0 THEN df_percent > {s.bootstrap_df_percent} ELSE df_percent > {s.df_percent} AND {pmi_max} < {s.pmi_max} AND {e} > {s.entropy} END"


def _score(e="entropy", s=STOP) -> str:
    return f"(df_percent / 100 + (1 - pmi_max) + CASE WHEN pmi_max = 0 THEN greatest({e}, {s.bootstrap_entropy}) ELSE {e} END) / 3"


def _discovery(rounds: int, thresholds, gone: tuple[str, ...], limit: int | None, en: bool) -> str:
    """CTEs v1, sc1, s1 ... : the rounds of stop-word discovery, one after the other over what is left."""
    ctes = [ALL_PAIRS] + ([_entropy("lang")] if en else [])
    vocabulary, scored_ = "v", "sc"
    if gone:
        ctes.append(f"v0 AS MATERIALIZED (SELECT * FROM v WHERE tok NOT IN ({_list(gone)})), sc0 AS MATERIALIZED (SELECT * FROM sc WHERE i IN (SELECT id FROM v0) AND j IN (SELECT id FROM v0))")
        vocabulary, scored_ = "v0", "sc0"
    for k in range(1, rounds + 1):
        ctes.append(f"{_hub(scored_, vocabulary, f'f{k}', f'q{k}')}, {_most(f'q{k}', f'mx{k}')}, s{k} AS MATERIALIZED (SELECT id, token, df, {_score(s=thresholds)} AS score FROM ({_rows(vocabulary, f'mx{k}', en)}) WHERE {_candidates(s=thresholds)}{f' ORDER BY round({_score(s=thresholds)}, 6) DESC, token LIMIT {limit}' if limit else ''})")
        if k < rounds:
            ctes.append(f"w{k} AS MATERIALIZED (SELECT * FROM {vocabulary} WHERE id NOT IN (SELECT id FROM s{k})), x{k} AS MATERIALIZED (SELECT * FROM {scored_} WHERE i NOT IN (SELECT id FROM s{k}) AND j NOT IN (SELECT id FROM s{k}))")
            vocabulary, scored_ = f"w{k}", f"x{k}"
    return ", ".join(ctes)


def _components(edges: str, hops: int = 14) -> str:
    """co(token, root) of edges(a, b): smallest labels spread to the neighbours and along themselves, round by round."""
    out = [f"ew AS MATERIALIZED (SELECT a AS u, b AS w FROM {edges} UNION SELECT b, a FROM {edges}), l0 AS MATERIALIZED (SELECT u, least(u, min(w)) AS r FROM ew GROUP BY u)"]
    for k in range(1, hops + 1):
        out.append(f"h{k} AS MATERIALIZED (SELECT ew.u, least(any_value(x.r), min(y.r)) AS r FROM ew JOIN l{k - 1} x ON x.u = ew.u JOIN l{k - 1} y ON y.u = ew.w GROUP BY ew.u), l{k} AS MATERIALIZED (SELECT a.u, least(a.r, b.r) AS r FROM h{k} a JOIN h{k} b ON b.u = a.r)")
    return ", ".join(out) + f", co AS MATERIALIZED (SELECT u AS token, r AS root FROM l{hops})"


def _cats_of(toks: str) -> str:
    by: dict[str, set[str]] = {}
    for kind in ("sectors", "events", "regions"):
        for name, ks in TAXONOMY[kind].items():
            by.setdefault(name, set()).update(ks)
    parts = ", ".join(f"CASE WHEN list_has_any({toks}, [{_list(sorted(ks))}]) THEN '{name}' END" for name, ks in sorted(by.items()))
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


KEYWORDS = "kw(category, keyword) AS (VALUES " + ", ".join(f"('{c}', '{k}')" for c, k in sorted({(n, k) for kind in ("sectors", "events", "regions") for n, ks in TAXONOMY[kind].items() for k in ks})) + ")"
ENTITY = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS type, '{name}' AS value FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) for kind, names in TAXONOMY["entities"].items() for name, ks in names.items())
TOPIC = ", ".join(f"CASE WHEN {' OR '.join(f'contains(s, {k!r})' for k in ks)} THEN '{name}' END" for name, ks in sources.TOPICS.items())
RULES = f"rl AS (SELECT 'related_to' AS relation, t1 AS subject, t2 AS object, score, n AS support, 0.6e0 / (1 + exp(-(score - 0.8e0))) + 0.4e0 / (1 + exp(-(n - 5e0))) AS confidence FROM p WHERE score >= 0.5)"
TITLE = "CASE WHEN regexp_extract(text, '^[^.!?]{1,119}[.!?]') <> '' THEN regexp_extract(text, '^[^.!?]{1,119}[.!?]') ELSE text END"
TAG = text.TAGS.replace("(?s:.*?)", r"(?:.|\n)*?").replace("'", "''")


def _decoded(t: str, digits: str, hexed: bool) -> str:
    """Numeric entities in a column t as characters."""
    mark, number = ("x", "('0x' || x)") if hexed else ("", "x")
    char = f"lambda x: chr(CASE WHEN {number}::BIGINT > 0 AND {number}::BIGINT <= 1114111 AND {number}::BIGINT NOT BETWEEN 55296 AND 57343 THEN {number}::INTEGER ELSE 65533 END)"
    return f"array_to_string(list_transform(list_zip(string_split_regex({t}, '&#{mark}{digits};'), list_transform(regexp_extract_all({t}, '&#{mark}({digits});', 1), {char})), lambda p: p[1] || coalesce(p[2], '')), '')"


STRIP = "t"
for _name, _char in text.ENTITIES.items():
    STRIP = f"replace({STRIP}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"
STRIP = f"regexp_replace({STRIP}, '^{text.SPACES}+|{text.SPACES}+$', '', 'g')"
STRIPPED = f"SELECT page_id, {STRIP} AS stripped FROM (SELECT page_id, {_decoded('t', '[0-9A-Fa-f]{1,8}', True)} AS t FROM (SELECT page_id, {_decoded('t', '[0-9]{1,9}', False)} AS t FROM (SELECT page_id, regexp_replace(html, '{TAG}', '', 'g') AS t FROM pages)))"
FACT_ROWS = "lit(relation, subject, object) AS (VALUES " + ", ".join(f"('{r}', '{s}', '{o}')" for r, s, o in FACTS) + ")"
ALL_FACTS = f"{FACT_ROWS}, facts AS (SELECT * FROM lit UNION SELECT 'is_a', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'is_a', r_name, 'WORLD' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation))"
CLOSURE = f"{ALL_FACTS}, cl(relation, subject, object) AS (SELECT * FROM facts UNION SELECT c.relation, c.subject, f.object FROM cl c JOIN facts f ON c.relation = f.relation AND c.object = f.subject WHERE c.relation IN ('is_a', 'related_to'))"
LINKS = "ln AS (SELECT subject AS token, object AS neighbor FROM {f} WHERE subject <> object UNION SELECT object, subject FROM {f} WHERE subject <> object)"


def _hops(seeds: str) -> str:
    """x(query_id, token, hops) of two hops from s(query_id, token)."""
    return f"""s AS ({seeds}), h AS (SELECT query_id, token, min(hops) AS hops FROM (SELECT query_id, token, 0 AS hops FROM s UNION ALL SELECT query_id, neighbor, 1 FROM s JOIN ln USING (token)
UNION ALL SELECT query_id, b.neighbor, 2 FROM s JOIN ln a ON s.token = a.token JOIN ln b ON a.neighbor = b.token) GROUP BY 1, 2),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, token) AS r FROM h WHERE hops > 0) WHERE r <= 50)"""


def _ask(one: bool) -> str:
    b = "(SELECT * FROM benchmark ORDER BY item_id LIMIT 1)" if one else "benchmark"
    return f"qq AS MATERIALIZED (SELECT item_id AS query_id, {ALL} AS qall, list_distinct({ALL}) AS qtoks FROM {b}), qt AS MATERIALIZED (SELECT query_id, unnest(qtoks) AS qt FROM qq)"


def _cand(wanted: str, k: int) -> str:
    return f"ca AS MATERIALIZED (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS r FROM (SELECT DISTINCT query_id, doc_id FROM {wanted} JOIN u USING (tok))) WHERE r <= {k})"


def _searching(one: bool) -> str:
    return f"""WITH {U}, {_ask(one)}, {FACT_ROWS}, {LINKS.format(f='lit')}, {_hops('SELECT query_id, qt AS token FROM qt')},
wanted AS (SELECT query_id, qt AS tok FROM qt UNION SELECT query_id, token FROM x), {_cand('wanted', 12)},
asked AS (SELECT DISTINCT qt FROM qt), pp AS MATERIALIZED (SELECT a.tok AS qt, b.tok AS dt, count(*) AS n FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.tok <> b.tok WHERE a.tok IN (SELECT qt FROM asked) GROUP BY 1, 2),
ps AS MATERIALIZED (SELECT qt, dt, b.df AS df_d, {_npmi('n', 'a.df', 'b.df')} AS score FROM pp JOIN df a ON a.tok = qt JOIN df b ON b.tok = dt CROSS JOIN nn),
nr AS (SELECT qt, least(10, count(*)) AS near FROM ps WHERE df_d >= 5 GROUP BY qt), sz AS (SELECT query_id, count(*) AS held FROM ca GROUP BY 1),
fa AS MATERIALIZED (SELECT query_id, qt, {_damp('(coalesce(near, 0) / (10e0 * held))')} AS factor FROM qt JOIN sz USING (query_id) LEFT JOIN nr USING (qt)),
be AS (SELECT query_id, doc_id, qt, greatest(0, max(score)) AS best FROM ca JOIN u USING (doc_id) JOIN qt USING (query_id) JOIN ps USING (qt) WHERE ps.dt = u.tok GROUP BY 1, 2, 3),
pt AS (SELECT query_id, doc_id, sum(coalesce(best, 0) * factor) / count(*) AS pmi, avg(factor) AS damping FROM ca JOIN fa USING (query_id) LEFT JOIN be USING (query_id, doc_id, qt) GROUP BY 1, 2),
br AS MATERIALIZED (SELECT *, pmi + 0.6e0 * cats + 0.8e0 * recency + 0.2e0 * authority - 0.05e0 * length AS total FROM (SELECT query_id, doc_id, coalesce(pmi, 0) AS pmi,
CASE WHEN len(qc) + len(dc) = 0 THEN 1e0 ELSE len(list_intersect(qc, dc))::DOUBLE / len(list_distinct(list_concat(qc, dc))) END AS cats, exp(-((1717200000 - (1704067200 + doc_id * 3600)) / 86400e0) / 14e0) AS recency, ln(doc_id % 7 + 1e0) AS authority, ln(len(toks) + 1e0) AS length, coalesce(damping, 1) AS damping
FROM ca JOIN (SELECT doc_id, toks, {_cats_of('toks')} AS dc FROM d) USING (doc_id) JOIN (SELECT query_id, {_cats_of('qtoks')} AS qc FROM qq) USING (query_id) LEFT JOIN pt USING (query_id, doc_id))),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, doc_id) AS rank FROM br) WHERE rank <= 3)"""


ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in PARTS)
CLUSTER_EDGES = "ed AS MATERIALIZED (SELECT t1 AS a, t2 AS b FROM p WHERE score >= 0.5)"
LINKED = f"lk AS MATERIALIZED (SELECT * FROM (SELECT a, b, n, {_npmi('n', 'x.df', 'y.df')} AS score FROM sk JOIN df x ON a = x.tok JOIN df y ON b = y.tok CROSS JOIN nn))"
PATHS = f"""{ALL_FACTS}, ok AS (SELECT * FROM facts WHERE relation IN ({_list(graph.PROVEN)})),
pa(relation, subject, object, path) AS (SELECT relation, subject, object, [subject, object] FROM ok UNION ALL SELECT pa.relation, pa.subject, ok.object, list_append(path, ok.object) FROM pa JOIN ok ON pa.relation = ok.relation AND pa.object = ok.subject
WHERE pa.object <> pa.subject AND NOT list_contains(path[2:], ok.object)),
be AS (SELECT subject, object, first(relation ORDER BY o, len(path), path) AS relation, first(path ORDER BY o, len(path), path) AS path FROM (SELECT *, list_position([{_list(graph.PROVEN)}], relation) AS o FROM pa) GROUP BY 1, 2)"""
OLD_NEW = f"new AS MATERIALIZED (SELECT doc_id, list_filter(toks, lambda x: x NOT IN ({_list(STOPS)})) AS toks FROM d WHERE doc_id % 3 = 0)"

SQL: dict[str, str] = {
    "tokenize_clean": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {KEPT} AS t FROM documents)",
    "lexicon_tokens": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform({ALL}, lambda x: CASE x {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in SYNONYMS.items())} ELSE x END), lambda x: x NOT IN ({_list(STOPS)}))) AS token FROM documents) GROUP BY 1, 2",
    "clean_text_urls": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\[source:[^\]]*\]', '', 'gi'), 'author\(s\):[^\n]*', '', 'gi'), 'https?://[^\s"''<>]+', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS clean FROM pages""",
    "strip_html": STRIPPED,
    "categorize_pages": f"SELECT page_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'tech' END AS topics FROM (SELECT page_id, list_filter([{TOPIC}], lambda x: x IS NOT NULL) AS l FROM (SELECT page_id, lower(url || ' ' || html) AS s FROM pages))",
    "category_codes": "SELECT CASE WHEN starts_with(c, 'view') THEN 'look' WHEN starts_with(c, 'purchase.1') THEN 'first-buyers' ELSE string_split(c, '.')[1] END AS code, count(*) AS n FROM (SELECT event_type || '.' || user_id AS c FROM events) GROUP BY 1",
    "story_titles": f"SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title FROM (SELECT doc_id, {TITLE} AS t FROM documents)",
    "doc_validity": f"SELECT source AS outlet, count(*) FILTER (trim(coalesce(text, '')) <> '' AND trim(coalesce({TITLE}, '')) <> '') AS valid, count(*) AS n FROM documents GROUP BY source",
    "doc_frequency": f"WITH {U} SELECT tok AS token, df, round(100e0 * df / big_n, 6) AS df_percent, round(ln(big_n::DOUBLE / (1 + df)), 6) AS idf FROM df, nn",
    "high_df_tokens": f"WITH {U} SELECT tok AS token, df, round(100e0 * df / big_n, 6) AS df_percent FROM df, nn ORDER BY df DESC, tok LIMIT 20",
    "bigram_counts": f"WITH {D}, {BIGRAMS} SELECT * FROM bg",
    "skipgram_counts": f"WITH {D}, {SKIPS} SELECT * FROM sk",
    "doc_pair_counts": f"WITH {_pairs('TRUE')}, ag AS (SELECT i AS id, count(*) AS k, sum(n) AS s, max(n) AS m FROM pn GROUP BY i UNION ALL SELECT j, count(*), sum(n), max(n) FROM pn GROUP BY j) SELECT tok AS token, sum(k)::BIGINT AS partners, sum(s)::BIGINT AS joint, max(m)::BIGINT AS most FROM ag JOIN v USING (id) GROUP BY tok",
    "pmi_pairs": f"WITH {_pairs('TRUE', _pmi)}, ag AS (SELECT i AS id, max(score) AS h, min(score) AS l, count(*) FILTER (score > 1e-9) AS k FROM sc GROUP BY i UNION ALL SELECT j, max(score), min(score), count(*) FILTER (score > 1e-9) FROM sc GROUP BY j) SELECT tok AS token, round(max(h), 6) AS highest, round(min(l), 6) AS lowest, sum(k)::BIGINT AS above FROM ag JOIN v USING (id) GROUP BY tok",
    "npmi_pairs": f"WITH {SUPPORTED} SELECT t1, t2, n, round(score, 6) AS score FROM p",
    "basket_npmi": f"WITH u AS MATERIALIZED (SELECT DISTINCT l_orderkey AS k, l_suppkey::VARCHAR AS tok FROM lineitem), nn AS (SELECT count(DISTINCT k) AS big_n FROM u), df AS (SELECT tok, count(*) AS df FROM u GROUP BY tok), pc AS (SELECT a.tok AS t1, b.tok AS t2, count(*) AS n FROM u a JOIN u b ON a.k = b.k AND a.tok < b.tok GROUP BY 1, 2) SELECT t1, t2, n, round({_npmi('n', 'x.df', 'y.df')}, 6) AS score FROM pc JOIN df x ON t1 = x.tok JOIN df y ON t2 = y.tok CROSS JOIN nn",
    "event_pair_npmi": f"WITH u AS MATERIALIZED (SELECT DISTINCT user_id AS k, event_type AS tok FROM events), nn AS (SELECT count(DISTINCT k) AS big_n FROM u), df AS (SELECT tok, count(*) AS df FROM u GROUP BY tok), pc AS (SELECT a.tok AS t1, b.tok AS t2, count(*) AS n FROM u a JOIN u b ON a.k = b.k AND a.tok < b.tok GROUP BY 1, 2) SELECT t1, t2, n, round({_npmi('n', 'x.df', 'y.df')}, 6) AS score FROM pc JOIN df x ON t1 = x.tok JOIN df y ON t2 = y.tok CROSS JOIN nn",
    "top_neighbors": f"WITH {NEAR_PAIRS}, {NEAR} SELECT token, neighbor, n, round(score, 6) AS score, rank FROM near",
    "phrase_pairs": f"WITH {HUBS}, {BIGRAMS}, bi AS (SELECT a, b, bg.n AS bigrams, least(x.id, y.id) AS i, greatest(x.id, y.id) AS j FROM bg JOIN v x ON a = x.tok JOIN v y ON b = y.tok WHERE a <> b) SELECT a, b, round(score, 6) AS score, bigrams, q.n AS support, round(bigrams * score, 6) AS phrase_score FROM bi JOIN q USING (i, j) WHERE score >= 0.01 ORDER BY round(bigrams * score, 6) DESC, bigrams DESC, a, b LIMIT 200",
    "linked_tokens": f"WITH {U}, {SKIPS}, {LINKED} SELECT a, b, n, round(score, 6) AS score FROM lk WHERE n >= {SUPPORT} AND score > 0.1",
    "token_categories": f"WITH {U} SELECT tok AS token, lang AS category, count(*) AS n FROM u JOIN d USING (doc_id) GROUP BY 1, 2",
    "token_category_entropy": f"WITH {U}, {_entropy('source')} SELECT tok AS token, round(entropy, 6) + 0e0 AS entropy FROM en",
    "damping_factors": f"WITH {HUBS} SELECT tok AS token, neighbors, round(factor, 6) AS factor FROM f JOIN v USING (id)",
    "stopword_stats": f"WITH {STOPROWS} SELECT token, df, round(df_percent, 6) AS df_percent, round(idf, 6) AS idf, round(pmi_max, 6) AS pmi_max, round(entropy, 6) + 0e0 AS entropy FROM ss",
    "stopword_candidates": f"WITH {STOPROWS} SELECT token, df, round(pmi_max, 6) AS pmi_max, round(entropy, 6) + 0e0 AS entropy, pmi_max = 0 AS bootstrap, round({_score()}, 6) AS score FROM ss WHERE {_candidates()}",
    "rule_suggestions": f"WITH {SUPPORTED}, {RULES} SELECT relation, subject, object, round(score, 6) AS score, support, round(confidence, 6) AS confidence FROM rl WHERE confidence >= 0.6",
    "rule_export": f"WITH {SUPPORTED}, {RULES} SELECT printf('%s(%s, %s). %% confidence %.2f support %d', relation, replace(subject, '-', '_'), replace(object, '-', '_'), confidence, support) AS line FROM rl",
    "taxonomy_assign": f"WITH {D} SELECT doc_id, array_to_string({_cats_of('toks')}, ',') AS cats FROM d",
    "entity_extract": ENTITY,
    "entity_suggestions": f"SELECT type, value, count(*) AS occurrences, round(1 - exp(-count(*) / 10e0), 6) AS confidence FROM ({ENTITY}) GROUP BY 1, 2 HAVING count(*) >= 3 AND 1 - exp(-count(*) / 10e0) >= 0.6",
    "taxonomy_drift": f"""WITH {U}, {KEYWORDS}, lo AS (SELECT category, keyword, coalesce(df, 0) AS df, coalesce(df, 0) / big_n::DOUBLE AS share, big_n - coalesce(df, 0) AS missed FROM kw LEFT JOIN df ON tok = keyword CROSS JOIN nn),
mc AS (SELECT tok, lang AS category FROM (SELECT tok, lang, row_number() OVER (PARTITION BY tok ORDER BY count(*) DESC, lang) AS r FROM u JOIN d USING (doc_id) GROUP BY tok, lang) WHERE r = 1)
SELECT 'low_coverage' AS kind, category, keyword AS token, df AS support, round(share, 6) AS share, round(least(1, greatest(0, 0.2e0 + 0.5e0 * (1 - exp(-missed / 10e0)) + 0.5e0 * (1 - share))), 6) AS confidence FROM lo WHERE share < 0.4 AND missed >= 10
UNION ALL SELECT 'orphan', coalesce(category, ''), tok, df, round(df / big_n::DOUBLE, 6), round(least(1, 0.2e0 + 0.8e0 * (1 - exp(-(df / big_n::DOUBLE) / 0.05e0)) + CASE WHEN coalesce(category, '') <> '' THEN 0.1e0 ELSE 0 END), 6) FROM df JOIN mc USING (tok) CROSS JOIN nn WHERE df >= 0.05 * big_n AND tok NOT IN (SELECT keyword FROM kw) AND tok NOT IN ({_list(STOPS)})""",
    "jaccard_categories": f"WITH {D} SELECT doc_id, round(len(list_intersect(c, ['english', 'french']))::DOUBLE / len(list_distinct(list_concat(c, ['english', 'french']))), 6) AS similarity FROM (SELECT doc_id, {_cats_of('toks')} AS c FROM d)",
    "inverted_index_lookup": f"WITH {U}, {_ask(False)}, wanted AS (SELECT query_id, qt AS tok FROM qt), {_cand('wanted', 20)} SELECT query_id, doc_id FROM ca",
    "score_breakdown": f"{_searching(False)} SELECT query_id, doc_id, {ROUND} FROM br",
    "search_topk": f"{_searching(True)} SELECT query_id, doc_id, rank, {ROUND} FROM tp",
    "batch_search": f"{_searching(False)} SELECT query_id, doc_id, rank, round(total, 6) AS total FROM tp",
    "cards": f"""{_searching(False)}, ex AS (SELECT query_id, array_to_string(list_sort(list(token)), '|') AS expanded FROM x WHERE token NOT IN (SELECT qt FROM qt WHERE qt.query_id = x.query_id) GROUP BY 1)
SELECT upper(left(sha256(query_id || chr(31) || doc_id), 26)) AS id, query_id, rank, {TITLE} AS title, {TITLE} AS bullets, 'doc://' || doc_id AS urls, array_to_string(list_sort(list_intersect(list_distinct(toks), qtoks)), '|') AS matched,
array_to_string({_cats_of('qtoks')}, '|') AS category_overlap, coalesce(expanded, '') AS expanded, round(pmi, 6) AS pmi, round(cats, 6) AS cats, round(recency, 6) AS recency, round(authority, 6) AS authority, round(length, 6) AS length FROM tp JOIN d USING (doc_id) JOIN qq USING (query_id) LEFT JOIN ex USING (query_id)""",
    "retrieve_with_neighbors": f"""WITH {NEAR_PAIRS}, {NEAR}, {_ask(False)}, w1 AS (SELECT query_id, qt AS tok FROM qt), w2 AS (SELECT DISTINCT query_id, neighbor AS tok FROM qt JOIN near ON token = qt WHERE rank <= 5),
{_cand('w1', 100)}, {_cand('w2', 100).replace('ca AS', 'cb AS')}, un AS (SELECT query_id, doc_id, min(way) AS way FROM (SELECT *, 0 AS way FROM ca UNION ALL SELECT *, 1 FROM cb) GROUP BY 1, 2)
SELECT query_id, doc_id, way = 0 AS direct FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY way, doc_id DESC) AS r FROM un) WHERE r <= 100""",
    "collisions": f"""WITH {NEAR_PAIRS}, {NEAR}, {_ask(False)}, st AS (SELECT query_id, list_position(qall, qt) AS pos, qt AS token, score AS strength FROM qt JOIN qq USING (query_id) JOIN near ON token = qt AND rank = 1 WHERE score >= 0.3)
SELECT query_id, a, b, round(strength_a, 6) AS strength_a, round(strength_b, 6) AS strength_b, round(j, 6) AS joint, round(greatest(0, 0.5e0 * sqrt(strength_a * strength_b) - j), 6) AS surprise FROM (SELECT x.query_id, x.token AS a, y.token AS b, x.strength AS strength_a, y.strength AS strength_b, coalesce(p.score, 0) AS j
FROM st x JOIN st y ON x.query_id = y.query_id AND x.pos < y.pos LEFT JOIN p ON t1 = least(x.token, y.token) AND t2 = greatest(x.token, y.token)) WHERE j <= 0.15 AND greatest(0, 0.5e0 * sqrt(strength_a * strength_b) - j) >= 0.1""",
    "prediction_error": f"""{_searching(False)}, {MORE_PAIRS}, {NEAR}, pr AS (SELECT DISTINCT query_id, neighbor AS tok FROM qt JOIN near ON token = qt), ac AS (SELECT DISTINCT query_id, tok FROM tp JOIN u USING (doc_id))
SELECT query_id, count(pr.tok) AS predicted, count(ac.tok) AS actual, count(*) FILTER (pr.tok IS NOT NULL AND ac.tok IS NOT NULL) AS shared, count(*) FILTER (ac.tok IS NULL) AS missing, count(*) FILTER (pr.tok IS NULL) AS unexpected, round(1 - count(*) FILTER (pr.tok IS NOT NULL AND ac.tok IS NOT NULL) / count(*)::DOUBLE, 6) AS error FROM pr FULL JOIN ac USING (query_id, tok) GROUP BY query_id""",
    "fact_closure": f"WITH RECURSIVE {CLOSURE} SELECT * FROM cl",
    "facts_provable": f"WITH RECURSIVE {CLOSURE}, nm AS (SELECT subject AS x FROM facts UNION SELECT object FROM facts), ask AS (SELECT relation, x AS subject, object FROM nm, (VALUES ('is_a'), ('used_for'), ('related_to')) r(relation), (VALUES ('WORLD'), ('corpus'), ('search')) o(object)) SELECT ask.*, cl.subject IS NOT NULL AS holds FROM ask LEFT JOIN cl USING (relation, subject, object)",
    "expand_tokens": f"WITH {ALL_FACTS}, {LINKS.format(f='facts')}, {_hops('SELECT DISTINCT subject AS query_id, subject AS token FROM facts')} SELECT query_id, token, round(pow(0.7e0, hops), 6) AS confidence FROM x",
    "neighbors_undirected": f"WITH {ALL_FACTS}, {LINKS.format(f='facts')} SELECT * FROM ln",
    "clusters": f"WITH {SUPPORTED}, {CLUSTER_EDGES}, {_components('ed')} SELECT root, string_agg(token, ',' ORDER BY token) AS tokens, count(*) AS size FROM co GROUP BY root HAVING count(*) >= 3",
    "synonym_groups": f"WITH {U}, {SKIPS}, {LINKED}, ed AS MATERIALIZED (SELECT * FROM lk WHERE n >= {SYNONYM_SUPPORT} AND score >= {SYNONYM_SCORE}), {_components('ed')}, en AS (SELECT root, max(score) AS score, sum(n)::BIGINT AS support FROM (SELECT a AS token, score, n FROM ed UNION ALL SELECT b, score, n FROM ed) JOIN co USING (token) GROUP BY root) SELECT root AS canonical, string_agg(token, ',' ORDER BY token) AS variants, round(any_value(score), 6) AS score, any_value(support) AS support FROM co JOIN en USING (root) WHERE token <> root GROUP BY root",
    "keyword_candidates": rf"WITH {U} SELECT tok AS token, df, round(100e0 * df / big_n, 6) AS df_percent FROM df, nn WHERE 100e0 * df / big_n BETWEEN 2 AND 60 AND strlen(tok) BETWEEN 3 AND 30 AND length(regexp_replace(tok, '\P{{Nd}}', '', 'g')) / strlen(tok)::DOUBLE <= 0.5 AND length(tok) - length(replace(tok, '-', '')) <= 2 AND tok NOT IN ({_list([*STOPS, *bootstrap.GENERIC])})",
    "reingest_deltas": f"WITH {D}, {OLD_NEW} SELECT tok AS token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS tok FROM (SELECT doc_id, toks FROM new UNION ALL SELECT doc_id, toks FROM d WHERE doc_id % 3 <> 0)) GROUP BY 1",
    "document_upsert": f"WITH {D}, {OLD_NEW} SELECT 'doc://' || doc_id AS url, doc_id, len(toks) AS n_tokens FROM (SELECT doc_id, toks FROM new UNION ALL SELECT doc_id, toks FROM d WHERE doc_id % 3 <> 0)",
    "prune_tokens": f"WITH {D}, {BIGRAMS} SELECT * FROM bg WHERE a NOT IN ({_list(STOPS)}) AND b NOT IN ({_list(STOPS)})",
    "cleaner_updates": f"WITH {D} SELECT doc_id, len({KEPT}) AS n_tokens FROM d WHERE {KEPT} <> toks",
    "category_histogram": f"WITH {D} SELECT category, count(*) AS n FROM (SELECT unnest({_cats_of('toks')}) AS category FROM d) GROUP BY 1",
    "event_trends": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, token, count(*) AS n FROM (SELECT DISTINCT event_id, ts, unnest([event_type, json_extract_string(props, '$.k')]) AS token FROM events) WHERE token IS NOT NULL GROUP BY 1, 2",
    "token_damping": f"""{_searching(False)}, {MORE_PAIRS}, {NEAR}, sizes AS (SELECT query_id, count(DISTINCT tok) AS size FROM tp JOIN u USING (doc_id) GROUP BY 1), hb AS (SELECT token, count(*) AS neighbors FROM nx WHERE score >= 0.05 GROUP BY 1),
td AS (SELECT query_id, qt AS token, coalesce(neighbors, 0) AS neighbors, coalesce(coalesce(neighbors, 0) / size::DOUBLE, 0) AS ratio FROM qt LEFT JOIN hb ON token = qt LEFT JOIN sizes USING (query_id)) SELECT query_id, token, neighbors, round({_damp('ratio')}, 6) AS factor FROM td""",
    "proof_path": f"WITH RECURSIVE {PATHS} SELECT subject, object, k::BIGINT AS depth, relation, path[k + 1] AS source, path[k + 2] AS target FROM (SELECT *, unnest(range(0, len(path) - 1)) AS k FROM be)",
    "phrase_parse": f"WITH {D}, hit AS (SELECT doc_id, len(toks) AS k, len(list_filter(range(1, len(toks)), lambda i: (toks[i] || ' ' || toks[i + 1]) IN ({_list(sorted({v for _, vs in PHRASES for v in vs}))}))) AS m FROM d) SELECT doc_id, k - m AS n_tokens, m AS n_phrases FROM hit",
    "autotune_rounds": f"WITH {_discovery(3, STOP, (), None, True)} {' UNION ALL '.join(f'SELECT {k}::BIGINT AS round, token, df, round(score, 6) AS score FROM s{k}' for k in (1, 2, 3))}",
    "bootstrap_rounds": f"WITH {_discovery(3, STOP, STOPS, 25, False)}, c AS (SELECT (SELECT count(*) FROM s1) AS c1, (SELECT count(*) FROM s2) AS c2, (SELECT count(*) FROM s3) AS c3), t AS (SELECT c1, c2, c3, {len(STOPS)} + c1 AS t1, {len(STOPS)} + c1 + c2 AS t2, {len(STOPS)} + c1 + c2 + c3 AS t3 FROM c) SELECT 1::BIGINT AS iteration, token, t1::BIGINT AS total_stopwords FROM s1, t UNION ALL SELECT 2, token, t2 FROM s2, t UNION ALL SELECT 3, token, t3 FROM s3, t UNION ALL SELECT 1, NULL, t1 FROM t WHERE c1 = 0 UNION ALL SELECT 2, NULL, t2 FROM t WHERE c1 > 0 AND c2 = 0 UNION ALL SELECT 3, NULL, t3 FROM t WHERE c1 > 0 AND c2 > 0 AND c3 = 0",
}

_QUERIES = (tokenize_clean, lexicon_tokens, clean_text_urls, strip_html, categorize_pages, category_codes, story_titles, doc_validity, doc_frequency, high_df_tokens, bigram_counts, skipgram_counts, doc_pair_counts, pmi_pairs, npmi_pairs, basket_npmi, event_pair_npmi, top_neighbors, phrase_pairs, linked_tokens, token_categories, token_category_entropy, damping_factors, stopword_stats, stopword_candidates, rule_suggestions, rule_export, taxonomy_assign, entity_extract, entity_suggestions, taxonomy_drift, jaccard_categories, inverted_index_lookup, score_breakdown, search_topk, batch_search, retrieve_with_neighbors, cards, collisions, prediction_error, token_damping, fact_closure, facts_provable, expand_tokens, neighbors_undirected, proof_path, phrase_parse, clusters, synonym_groups, keyword_candidates, reingest_deltas, document_upsert, prune_tokens, autotune_rounds, bootstrap_rounds, cleaner_updates, category_histogram, event_trends)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
