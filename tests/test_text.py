import pytest
from pyspark.sql import functions as F

from glosswork.functions import text
from glosswork.operators.tagging import Phrases, categories, entities, processed
from glosswork.sources import corpus


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("machine learning 2023 gpt-4 utf-8", ["machine", "learning", "gpt-4", "utf-8"]),
        ("hello! world? test... end.", ["hello", "world", "test", "end"]),
        ("a b c machine learning", ["machine", "learning"]),
        ("million-to-one -fitzgerald-wreck-diving a--b", ["million-to-one", "fitzgerald-wreck-diving", "a-b"]),
        ("Größe É 12-34 --- ½", ["größe", "é", "½"]),
        ("", []),
    ],
)
def test_tokens(spark, given, want):
    assert value(spark, text.tokens(F.lit(given))) == want


def test_synonyms_come_before_stop_words(spark):
    assert value(spark, text.tokens(F.lit("Cars and autos drive"), ["and", "car"], {"cars": "car", "autos": "vehicle"})) == ["vehicle", "drive"]


def test_null_text(spark):
    assert value(spark, text.tokens(F.lit(None).cast("string"))) is None


def test_cleaning(spark):
    assert value(spark, text.squeezed(text.without_links(F.lit("A [Source: http://x.y/z] b\nAuthor(s): me, you\nc https://a.b/c d")))) == "A b c d"
    assert value(spark, text.stripped_html(F.lit(" <p>a &lt;b&gt; &amp;amp;</p><script>x</script> "))) == "a <b> &amp;x"
    html = '<!-- a > b --><a title="x > y" href=\'<\'>A&#233;&#x20AC;&nbsp;&mdash;&amp;#65;&#0;&#55296;</a>\\n<br/> 1 < 2 &hellip;<!-- \\n -->&#128512;\u00a0'
    assert value(spark, text.stripped_html(F.lit(html.replace("\\n", "\n")))) == "A\u00e9\u20ac\u00a0\u2014&#65;\ufffd\ufffd\n 1 < 2 \u2026\U0001f600"
    assert value(spark, text.labelled(F.lit("Startup Raises $10M Series A"), corpus.TOPICS, "tech")) == ["ai", "startup"]
    assert value(spark, text.labelled(F.lit("nothing"), corpus.TOPICS, "tech")) == ["tech"]
    assert value(spark, text.coded(F.lit("cs.AI"), corpus.CODES)) == "ai" and value(spark, text.coded(F.lit("math.CO"), corpus.CODES)) == "math"
    assert value(spark, text.story_title(F.lit("One day. Two."))) == "One day." and value(spark, text.story_title(F.lit(". x"))) == ". x"
    assert value(spark, text.shortened(F.lit("abcdefgh"), 6)) == "abc..."
    assert value(spark, text.distinct_words(F.array(*map(F.lit, ["b", "", "a", "b"])))) == ["b", "a"]
    assert value(spark, text.digit_share(F.lit("a1b2"))) == 0.5
    assert len(value(spark, text.card_id(F.lit("x")))) == 26


def test_jaccard(spark):
    of = lambda a, b: value(spark, text.jaccard(*(F.array(*map(F.lit, x)).cast("array<string>") for x in (a, b))))
    assert of(["ai", "ml", "nlp"], ["ai", "web"]) == 0.25 and of(["ai"], ["web"]) == 0 and of(["ai"], ["ai"]) == 1 and of([], []) == 1


def test_phrases(spark):
    p = Phrases([("machine learning", ["ml"]), ("neural network", ["nn"])])
    assert p.parse("deep machine learning uses neural network ML".split()) == ["deep", "machine learning", "uses", "neural network", "machine learning"]
    assert Phrases([("language model", []), ("large language model", ["llm"])]).parse("large language model training".split()) == ["large language model", "training"]
    df = spark.createDataFrame([(["use", "ml"],), (None,), ([],)], "t array<string>")
    assert [r["x"] for r in df.select(p.column(F.col("t")).alias("x")).collect()] == [["use", "machine learning"], None, []]
    assert Phrases([("a", ["x"]), ("b", ["x"])]).parse(["x"]) == ["b"]


def test_phrase_query_counts_as_the_parser_does(spark, sf):
    from glosswork.plans import roster

    p = Phrases(roster.PHRASES)
    docs = roster._docs(spark, sf).select("doc_id", "tokens").collect()
    want = sorted((r["doc_id"], len(o := p.parse(r["tokens"])), sum(" " in x for x in o)) for r in docs)
    assert sorted(map(tuple, roster.phrase_parse(spark, sf).collect())) == want


def test_tagging(spark):
    kinds = {"company": {"Tesla": ["tesla", "tsla"], "Apple": ["apple", "aapl"]}}
    got = value(spark, entities(F.lit("Tesla and Apple announced new products"), kinds))
    assert sorted(map(tuple, got)) == [("company", "Apple"), ("company", "Tesla")]
    tax = {"sectors": {"ai": ["model"]}, "events": {"launch": ["announced"], "ai": ["ml"]}}
    assert value(spark, categories(F.array(F.lit("ml"), F.lit("announced")), tax)) == ["ai", "launch"]
    assert value(spark, categories(F.array(F.lit("x")), {})) == []
    df = processed(spark.createDataFrame([("ML announced by Tesla",)], "text string"), F.col("text"), ["by"], None, Phrases([("ml", [])]), tax, kinds)
    r = df.first()
    assert r["tokens"] == ["ml", "announced", "tesla"] and r["cats"] == ["ai", "launch"] and r["ents"][0]["value"] == "Tesla"
