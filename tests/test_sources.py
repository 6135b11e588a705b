import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glosswork.operators import bootstrap
from glosswork.sources import config, corpus


def test_json_lines(spark, tmp_path):
    good = {"url": "u", "title": "t", "outlet": "o", "published_at": "2024-01-01T00:00:00Z", "text": "x", "source_cats": ["a"]}
    (tmp_path / "d.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(good | {"url": "v"}) + "\n")
    out = corpus.json_lines(spark, str(tmp_path / "d.jsonl"))
    assert sorted(r["url"] for r in out.collect()) == ["u", "v"] and out.first()["published_at"] == datetime(2024, 1, 1)
    (tmp_path / "e.jsonl").write_text("{broken\n")
    with pytest.raises(ValueError):
        corpus.json_lines(spark, str(tmp_path / "e.jsonl"))


def test_stories(spark, tmp_path):
    (tmp_path / "s.txt").write_text("One.\nTwo.<|endoftext|>\n \n<|endoftext|>Three")
    assert [r["text"] for r in corpus.stories(spark, str(tmp_path / "s.txt")).collect()] == ["One.\nTwo.", "Three"]
    assert corpus.stories(spark, str(tmp_path / "s.txt"), 1).count() == 1


def test_atom(spark, tmp_path):
    who = "".join(f"<author><name>A{i}</name></author>" for i in range(4))
    (tmp_path / "f.xml").write_text(f'<feed><entry><id>i1</id><title>A  b</title><summary>s\n t</summary><published>2024-01-02T03:04:05Z</published>{who}<category term="cs.AI"/><category term="cs.LG"/></entry><entry><id>i2</id><title>B</title><summary>x</summary><published>never</published></entry></feed>')
    r = {x["url"]: x for x in corpus.atom(spark, str(tmp_path / "f.xml"), F.timestamp_seconds(F.lit(0))).collect()}
    assert r["i1"]["title"] == "A b" and r["i1"]["text"] == "s t Author(s): A0, A1, A2, et al." and r["i1"]["source_cats"] == ["ai", "machine-learning"]
    assert r["i2"]["source_cats"] == ["research"] and r["i2"]["published_at"] == datetime(1970, 1, 1)


def test_story_items(spark):
    rows = [("story", "GPU news", "http://x", "<p>hi</p>", 0), ("job", "t", "u", "x", 0), ("story", "", "u", "x", 0), ("story", "T", None, None, 5)]
    out = {r["title"]: r for r in corpus.story_items(spark.createDataFrame(rows, "type string, title string, url string, text string, time long")).collect()}
    assert set(out) == {"GPU news", "T"} and out["GPU news"]["text"] == "GPU news. hi [Source: http://x]" and out["GPU news"]["source_cats"] == ["hardware"]
    assert out["T"]["text"] == "T. "


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("terms: [The, and]\n")
    (tmp_path / "t.yaml").write_text("sectors: {ai: [model]}\nentities: {company: {X: [x]}}\n")
    (tmp_path / "d").write_text("# c\nmachine learning|ml|ai\nalone\na|b\n")
    (tmp_path / "l.yaml").write_text("synonyms:\n  - canonical: Car\n    variants: [Auto, cars]\n")
    c = config.load(*(str(tmp_path / x) for x in ("s.yaml", "t.yaml", "d", "l.yaml")), "r")
    assert c.stops == ["The", "and"] and c.taxonomy["events"] == {} and c.phrases == [("machine learning", ["ml"], "ai"), ("a", [], "b")] and c.rules_path == "r"
    assert c.lexicon.normalize("AUTO") == "car" and c.lexicon.variants("car") == ["car", "auto", "cars"] and c.lexicon.stats() == (1, 3)
    assert config.load().stops == [] and config.load().phrases == [] and config.load().rules_path is None
    assert config.blacklist(str(tmp_path / "none")) == set() and config.blacklist(str(tmp_path / "s.yaml")) == {"the", "and"}


def test_lexicon_groups_and_links():
    lex = config.Lexicon([("a", ["b", "c"])])
    lex.add("a", ["d"])
    assert lex.normalize("b") == "b" and lex.normalize("d") == "a"
    lex.link("a", "x", 1.0, 5)
    lex.link("a", "x", 1.0, 3)
    lex.link("a", "x", 2.0, 1)
    assert lex.linked["a"]["x"] == (2.0, 1)


def test_rules(spark):
    got = config.rules(["# c", "", "is_a(b, c). % x", "is_a(b, c)", "r(x y, z)"])
    assert got == [("is_a", "b", "c"), ("r", "x y", "z")]
    assert config.facts(spark, got).count() == 2
    with pytest.raises(ValueError, match="line 2"):
        config.rules(["is_a(a, b)", "what"])


def test_bootstrap_files(tmp_path):
    yaml = pytest.importorskip("yaml")
    bootstrap.write(str(tmp_path), ["b", "a"], [("x", "y")], [{"canonical": "c", "variants": ["d"]}], {"domain-1": ["x"]}, {"total_docs": 1})
    assert config.stoplist(str(tmp_path / "stoplist.yaml")) == ["a", "b"]
    assert config.dictionary((tmp_path / "tokens.dict").read_text().splitlines()) == [("x y", ["x y"], "domain-1")]
    assert config.Lexicon.load(str(tmp_path / "synonyms.yaml")).normalize("d") == "c"
    assert config.taxonomy(str(tmp_path / "taxonomies.yaml"))["sectors"] == {"domain-1": ["x"]}
    assert json.loads((tmp_path / "bootstrap-report.json").read_text()) == {"total_docs": 1} and yaml
