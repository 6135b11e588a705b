import json
from datetime import datetime, timezone

import pytest

from glosswork import cli
from glosswork.engine import Engine, Options, prompt, summarised
from glosswork.operators import search
from glosswork.sources import config, corpus

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


def items(n=12):
    topics = (("deep neural networks learn from data", "Networks"), ("cats and dogs play in the garden", "Pets"), ("solar panels turn light into power", "Energy"))
    return [{"url": f"u{i}", "title": f"{topics[i % 3][1]} {i}", "outlet": "o", "published_at": f"2024-01-{i + 1:02}T00:00:00Z", "text": f"{topics[i % 3][0]} number{i}", "source_cats": ["x"]} for i in range(n)]


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_ingest_search_card(spark, tmp_path):
    parts = config.Components(stops=["the", "and"], taxonomy={"sectors": {"ai": ["neural"]}, "entities": {}})
    e = Engine(spark, str(tmp_path / "s"), parts, config.facts(spark, [("related_to", "brain", "neural")]))
    e.ingest(corpus.json_lines(spark, write(tmp_path / "d.jsonl", items())))
    top = e.search("neural networks", 3, NOW).orderBy("rank").collect()
    assert len(top) == 3 and top[0]["pmi"] > 0 and top[0]["cats"] == 0.5
    assert [r["recency"] for r in top] == sorted((r["recency"] for r in top), reverse=True)
    cards = e.cards("brain", 3, NOW).collect()
    assert len(cards) == 3 == len({c["id"] for c in cards}) and [c["rank"] for c in cards] == [1, 2, 3]
    card = cards[0]
    assert card["expanded"] == ["neural"] and len(card["id"]) == 26 and card["title"].startswith("Networks") and card["bullets"] == [card["title"]]
    one = e.cards("neural cats", 1, NOW).first()
    assert one["category_overlap"] == ["ai"] and one["query_tokens"] == ["neural", "cats"] and len(one["matched"]) == 1
    # the store's index answers as the whole corpus does
    q = e.query("neural networks in the garden")
    show = lambda df: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select("query_id", "doc_id", "pmi", "cats", "recency", "authority", "length", "damping", "total").collect())
    assert show(search.from_store(e.store, q, NOW, min_df=2)) == show(search.breakdown(e.docs(), q, NOW, min_df=2))
    sig = e.signals("neural garden", 3, NOW)
    assert set(sig) == {"collisions", "prediction_error", "token_damping"}
    assert sig["prediction_error"].first()["actual"] > 0 and {r["token"] for r in sig["token_damping"].collect()} == {"neural", "garden"}
    assert e.store.document(url="u1").first()["title"] == "Pets 1"
    assert e.search("nothing here", 3, NOW).count() == 0
    asked = summarised([card.asDict()], "why?", lambda p: p)[0]
    assert asked == prompt(card.asDict(), "why?") and "Networks" in asked


def test_tune_persists_and_rebuild_filters(spark, tmp_path):
    rows = [dict(r, text="the " + r["text"] + f" word{k}") for k, r in enumerate(items())]
    seen = {}
    ask = {k: (lambda k: lambda rs: seen.setdefault(k, [r["key"] for r in rs]))(k) for k in ("rules", "taxonomy", "entities")}
    parts = config.Components(taxonomy={"sectors": {"old": ["dinosaur"]}, "entities": {"topic": {"net": ["neural"]}}})
    e = Engine(spark, str(tmp_path / "s"), parts, options=Options(reviewers=ask))
    e.set_taxonomy(parts.taxonomy)
    e.ingest(corpus.json_lines(spark, write(tmp_path / "d.jsonl", rows)))
    out = e.tune(2, least=0.3, support=3, confidence=0.4)
    assert "the" in {r["token"] for r in out["stopwords"].collect()}
    rules = {(r["relation"], r["subject"], r["object"]) for r in out["rules"].collect()}
    assert ("related_to", "deep", "neural") in rules and len(seen["rules"]) == len(rules)
    assert ("low_coverage", "dinosaur") in {(r["kind"], r["token"]) for r in out["taxonomy"].collect()} and out["entities"].columns[:2] == ["type", "value"]
    assert {r["category"] for r in e.store.view("dict").collect()} == {"related_to"}
    fresh = Engine(spark, str(tmp_path / "s"))
    fresh.rebuild()
    assert "the" in fresh.components.stops and fresh.components.taxonomy["sectors"] == {"old": ["dinosaur"]}
    assert rules == {tuple(r) for r in fresh.facts.select("relation", "subject", "object").collect()}
    fresh.ingest(corpus.json_lines(spark, write(tmp_path / "d.jsonl", rows)))
    assert all("the" not in r["tokens"] for r in fresh.docs().collect()) and fresh.docs().count() == 12
    fresh.options.most_stops = 0
    with pytest.raises(ValueError):
        fresh.rebuild()


def test_reviewers_refuse(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), options=Options(reviewers={k: lambda rows: [] for k in ("rules", "taxonomy", "entities", "stopwords")}))
    e.ingest(corpus.json_lines(spark, write(tmp_path / "d.jsonl", items())))
    assert {k: v.count() for k, v in e.tune(1, least=0.1, support=1, confidence=0.0).items()} == {"stopwords": 0, "rules": 0, "taxonomy": 0, "entities": 0}


def test_cli(spark, tmp_path):
    data = write(tmp_path / "d.jsonl", items())
    assert cli.main(["index", "--data", data, "--store", str(tmp_path / "s")]) == "12 documents"
    cards = [json.loads(x) for x in cli.main(["search", "--store", str(tmp_path / "s"), "--query", "solar panels"]).splitlines()]
    assert len(cards) == 3 and all(c["title"].startswith("Energy") for c in cards)
    for name, text in (("stop.yaml", "terms: []"), ("tax.yaml", "sectors: {}"), ("words.dict", "# none"), ("agent.yaml", f"store: {tmp_path}/s\nstoplist: {tmp_path}/stop.yaml\ntaxonomy: {tmp_path}/tax.yaml\ndict: {tmp_path}/words.dict\ntop_k: 2\n"), ("bad.yaml", "store: x")):
        (tmp_path / name).write_text(text)
    if config.yaml is not None:
        said = cli.main(["chat", "--config", str(tmp_path / "agent.yaml"), "--query", "solar panels"], lambda p: f"asked {p.count('Energy')}").splitlines()
        assert len(said) == 4 and said[-1] == "asked 2"
        assert cli.main(["chat", "--config", str(tmp_path / "agent.yaml"), "--query", "zebra"]) == "No facts found."
        with pytest.raises(ValueError, match="stoplist"):
            cli.main(["chat", "--config", str(tmp_path / "bad.yaml"), "--query", "x"])
    report = json.loads(cli.main(["analyze", "--data", data]))
    assert report["total_docs"] == 12 and report["high_df_tokens"]
    cli.main(["bootstrap", "--data", data, "--out", str(tmp_path / "o"), "--iterations", "2"])
    assert {p.name for p in (tmp_path / "o").iterdir()} == {"stoplist.yaml", "tokens.dict", "synonyms.yaml", "taxonomies.yaml", "bootstrap-report.json"}
    assert json.loads(cli.main(["analyze", "--data", data, "--iterations", "0"]))["iterations"] == []
