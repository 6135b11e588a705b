"""Corpora: JSON lines, delimited stories, Atom feeds, story items, and the Parquet tables of a test folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import coded, labelled, squeezed, stripped_html
from ..runtime import spread

ITEM = "url string, title string, outlet string, published_at timestamp, text string, source_cats array<string>"
TOPICS = {"ai": ["ai", "machine learning", "neural"], "startup": ["startup", "raises", "funding"], "security": ["security", "vulnerability", "breach"], "programming": ["rust", "python", "compiler"], "hardware": ["chip", "gpu", "cpu"], "science": ["physics", "biology", "space"]}
CODES = {"cs.AI": "ai", "cs.LG": "machine-learning", "cs.CL": "nlp", "cs.CV": "vision", "stat.ML": "machine-learning"}


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items; malformed lines go. A file without one valid line is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", ITEM + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    out = parsed.where("_bad is null").drop("_bad")
    if out.isEmpty():
        raise ValueError(f"no valid item in {path}")
    return out


def stories(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(text) of the pieces between <|endoftext|> marks, blank ones left out."""
    out = spark.read.option("lineSep", "<|endoftext|>").text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text")).where("text <> ''")
    return out if limit is None else out.limit(limit)


def atom(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Items of an Atom feed: bad dates are now, categories are coded (research without any), three authors at most are named."""
    person = "array<struct<name:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(f"id string, title string, summary string, published string, author {person}, category array<struct<_term:string>>").load(path)
    names = F.transform(F.coalesce("author", F.array().cast(person)), lambda a: a["name"])
    who = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, ", et al.").otherwise(""))
    cats = F.array_distinct(F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda c: coded(c["_term"], CODES)))
    text = F.concat(squeezed(F.coalesce("summary", F.lit(""))), F.when(F.size(names) > 0, F.concat(F.lit(" Author(s): "), who)).otherwise(""))
    return raw.select(F.trim("id").alias("url"), squeezed(F.col("title")).alias("title"), F.lit("feed").alias("outlet"), F.coalesce(F.try_to_timestamp(F.trim("published")), now if now is not None else F.current_timestamp()).alias("published_at"), text.alias("text"), F.when(F.size(cats) > 0, cats).otherwise(F.array(F.lit("research"))).alias("source_cats"))


def story_items(raw: DataFrame) -> DataFrame:
    """Items from downloaded stories (type, title, url, text, time in seconds); other types and untitled ones go."""
    body = F.concat(F.col("title"), F.lit(". "), stripped_html(F.coalesce("text", F.lit(""))), F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(" [Source: "), F.col("url"), F.lit("]"))).otherwise(""))
    return raw.where((F.col("type") == "story") & (F.coalesce("title", F.lit("")) != "")).select("url", "title", F.lit("stories").alias("outlet"), F.timestamp_seconds("time").alias("published_at"), body.alias("text"), labelled(F.concat_ws(" ", "title", "url"), TOPICS, "tech").alias("source_cats"))


def valid(body: str = "text") -> Column:
    """Whether an item has a url, a title, a body and a time."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return filled("url") & filled("title") & filled(body) & F.col("published_at").isNotNull()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a test folder; the texts of small ones are dealt out to all cores."""
    path = f"{folder}/{name}.parquet"
    found = spark.read.parquet(path)
    return spread(found, path) if name == "documents" else found


def as_docs(documents: DataFrame) -> DataFrame:
    """The documents table as a corpus: url, outlet, source categories, a time that follows the id, links."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return documents.select("doc_id", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("outlet"), F.array("lang").alias("source_cats"), at.alias("published_at"), (F.col("doc_id") % 7).cast("int").alias("links_out"), "text")
