"""Command line: python -m glosswork.cli index|search|analyze|bootstrap|chat ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine, summarised, together
from .functions import text
from .operators import bootstrap, graph, stats
from .sources import config, corpus


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glosswork")
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in (("index", ("data", "store")), ("search", ("store", "query")), ("analyze", ("data",)), ("bootstrap", ("data", "out")), ("chat", ("config", "query"))):
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(f"--{n}", required=True)
        for n in ("stoplist", "taxonomy", "dict", "lexicon", "rules"):
            c.add_argument(f"--{n}")
        c.add_argument("--top", type=int, default=3)
        c.add_argument("--iterations", type=int, default=3)
        c.add_argument("--min-score", type=float, default=0.3)
        c.add_argument("--min-support", type=int, default=3)
    return p


def chat(spark: SparkSession, path: str, question: str, ask=None) -> str:
    """Cards for a question to the store that an agent's YAML names (store, stoplist, dict, taxonomy, rules, top_k), and,
    with ask, which calls a language model, its summary."""
    conf = config.load_yaml(path)
    if missing := [k for k in ("store", "stoplist", "dict", "taxonomy") if not conf.get(k)]:
        raise ValueError(f"{', '.join(missing)} missing in {path}")
    engine = Engine(spark, conf["store"], config.load(conf["stoplist"], conf["taxonomy"], conf["dict"], None, conf.get("rules")))
    found = [r.asDict(recursive=True) for r in engine.cards(question, int(conf.get("top_k") or 0) or 3).collect()]
    if not found:
        return "No facts found."
    lines = [json.dumps(c, default=str) for c in found]
    return "\n".join(lines if ask is None else [*lines, "Summary:", *summarised([together(found)], question, ask)])


def main(argv: list[str] | None = None, ask=None) -> str:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "chat":
        return chat(spark, a.config, a.query, ask)
    parts = config.load(a.stoplist, a.taxonomy, a.dict, a.lexicon, a.rules)
    if a.command in ("index", "search"):
        engine = Engine(spark, a.store, parts)
        engine.rebuild()
        if a.command == "index":
            engine.ingest(corpus.json_lines(spark, a.data))
            return f"{engine.docs().count()} documents"
        return "\n".join(engine.cards(a.query, a.top).toJSON().collect())
    items = corpus.json_lines(spark, a.data).withColumn("doc_id", F.xxhash64("url"))
    docs = items.withColumn("tokens", text.tokens(text.without_links(F.col("text")), parts.stops, parts.lexicon.canonical))
    now, rounds = bootstrap.run(docs, parts.stops, a.iterations)
    if now is None:
        return json.dumps({"total_docs": 0, "iterations": []})
    n = now.count()
    occ = stats.members(now)
    df = stats.cut(stats.frequencies(occ))
    found = stats.cut(stats.scored(stats.pairs(occ, df), n))
    phrases = [r.asDict() for r in stats.supported_phrases(stats.bigrams(now), found, a.min_score, a.min_support, 200).collect()]
    stops = sorted({*parts.stops, *(w for r in rounds for w in r["new_stopwords"])})
    high = [r.asDict() for r in stats.frequency_stats(df, n).orderBy(F.desc("df"), "token").limit(20).collect()]
    report = {"total_docs": n, "iterations": rounds, "stopwords": stops, "pairs": phrases, "high_df_tokens": high}
    if a.command == "bootstrap":
        linked = stats.cut(stats.linked_tokens(stats.skipgrams(now), df, n, a.min_support, ordered=True).where(F.col("score") >= a.min_score))
        groups = [r.asDict() for r in graph.synonym_groups(linked, 100).collect()]
        edges = spark.createDataFrame([(p["a"], p["b"]) for p in phrases], "a string, b string")
        topics = bootstrap.taxonomy(edges, bootstrap.keywords(df, n, stops))
        report |= {"synonym_candidates": groups, "taxonomy": topics}
        bootstrap.write(a.out, stops, [(p["a"], p["b"]) for p in phrases], groups, topics, report)
    return json.dumps(report, default=str)


if __name__ == "__main__":
    print(main())
