"""Table access and the derived views every operator reads.

The driver supplies generic tables (``events``, ``documents``, ...). The
views below re-express them in the data model of the relevance system
(activity rows, posts, features, queries, judgements). Each is a lazy
DataFrame: projections and filters applied downstream reach the parquet
scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions.text import first_words
from relevo.operators.util import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Keyword list that exists in the fixture corpora (the configured list does
# not occur there; it is exercised on synthetic posts instead).
FIXTURE_KEYWORDS = ["that the", "is and"]
# Synonym rules over words that occur in the fixture texts, of both kinds.
FIXTURE_SYNONYMS = ["the => of", "and, in, to", "that => thing and"]
#: Rules of several words over words of the fixtures.
FIXTURE_PHRASES = ["of the => about that thing, from", "of the in => inside", "de la, du", "the => that", "in, und der, dans le"]
# Training cut-off inside the fixture's event span (2024-01-01 .. 2024-01-30).
FIXTURE_CUTOFF = "2024-01-20 00:00:00"

# Two linear-congruential constants turn a doc id into a reproducible score.
_LCG_MOD = 2147483648
_LCG_EXPERTISE = (1103515245, 12345)
_LCG_UTILITY = (22695477, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, listed anew for every view so that new files are seen."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text-heavy table, spread over the cluster's cores when its scan is too narrow."""
    return spread(table(spark, sf_dir, name), key)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows ``(id, author, subreddit, score, created_utc)`` from ``events``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("subreddit"),
        F.col("value").cast("decimal(18,2)").alias("score"),
        F.col("ts").alias("created_utc"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post texts ``(id, author, subreddit, title, body, lang)`` from ``documents`` (no labels)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.col("source").alias("subreddit"),
        first_words("text", 8).alias("title"),
        F.col("text").alias("body"),
        F.col("lang"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts ``(id, author, subreddit, title, body, lang, label)``: the corpus plus quality labels."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return corpus(spark, sf_dir).join(labels, "id", "left")


def posts_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows keyed like ``posts`` (shares authors and subreddits with it)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.col("source").alias("subreddit"),
        (F.col("n_chars") % 100).cast("decimal(18,2)").alias("score"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_utc"),
    )


def _lcg(mult: int, inc: int):
    x = F.col("id") % _LCG_MOD
    return ((x * mult + inc) % _LCG_MOD).cast("double") / F.lit(float(_LCG_MOD))


def _score_columns():
    return [F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(_lcg(*_LCG_EXPERTISE)).alias("expertise_score"),
            F.when(F.col("id") % 11 == 5, F.lit(None)).otherwise(_lcg(*_LCG_UTILITY)).alias("utility_score")]


def post_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with stored ``expertise_score`` / ``utility_score`` (the training table).

    Scores are reproducible functions of the id; expertise is missing on ids
    divisible by 11, utility on ids congruent to 5 mod 11.
    """
    return posts(spark, sf_dir).select("*", *_score_columns())


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feature columns per document ``(id, expertise_score, utility_score)``,
    without the label join (what serving reads)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select("id", *_score_columns())


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query table ``(query_id, query_text)``: first 8 words of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), first_words("text", 8).alias("query_text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latency sample in milliseconds (one row per event)."""
    return table(spark, sf_dir, "events").select("event_id", F.col("value").alias("latency_ms"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs without scheme, query string and fragment."""
    url = F.col("url")
    no_scheme = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace(no_scheme, r"[?#].*$", "").alias("path"))
