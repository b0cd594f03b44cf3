"""Author signals: topical reputation (G1), utility hits (G2), global totals (G3),
and the enrichment join that attaches both to posts (J1).

Scale notes
- Both signals are one ``groupBy`` on (author, subreddit): Spark plans a
  partial aggregate before the shuffle, so a hot author (say a third of all
  rows) is combined map-side and never lands whole in one task.
- The grouped table is written once; the global total (a scalar subquery) and
  the rows are read from it, so the activity is scanned and shuffled once.
- Both signals are combined into one table with a row per key, so posts are
  joined once, and a hot key is split by AQE's skew-join handling.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevo.functions.fixed import MIN_UPVOTE_THRESHOLD
from relevo.functions.text import has_any_keyword
from relevo.session import write_shared


# ln() may differ in the last bit between math libraries; 12 decimals are kept
LOG_DIGITS = 12


def _ts(cutoff) -> Column:
    """A cut-off as a wall-clock timestamp in the session time zone (UTC).

    Python datetimes are passed as text: a naive datetime literal would be
    interpreted in the driver's local time zone."""
    if isinstance(cutoff, datetime):
        if cutoff.tzinfo is not None:
            cutoff = cutoff.astimezone(timezone.utc).replace(tzinfo=None)
        cutoff = cutoff.isoformat(sep=" ")
    return F.lit(str(cutoff)).cast("timestamp")


def user_activity(activity: DataFrame, cutoff) -> DataFrame:
    """Per (author, subreddit) post count and upvote sum before ``cutoff`` (strict)."""
    return (activity
            .where((F.col("created_utc") < _ts(cutoff)) & F.col("author").isNotNull())
            .groupBy("author", "subreddit")
            .agg(F.count("id").alias("post_count"), F.sum("score").alias("total_upvotes")))


def global_totals(activity: DataFrame, cutoff) -> DataFrame:
    """One row: total posts and total upvotes over all groups, unfiltered by threshold."""
    ua = user_activity(activity, cutoff)
    return ua.agg(F.sum("post_count").alias("total_posts"),
                  F.sum("total_upvotes").cast("double").alias("total_global_upvotes"))


def topical_reputation(activity: DataFrame, cutoff, min_upvotes: int = MIN_UPVOTE_THRESHOLD) -> DataFrame:
    """Topical reputation per (author, subreddit) (G1).

    ``topical_focus_score`` divides a group's upvotes by the sum over *all*
    groups (before the threshold); a zero total gives NULL.
    ``activity_density`` is ``ln(post_count + 1)`` (12 decimals). Sorted by
    focus, descending.
    """
    ua = write_shared(user_activity(activity, cutoff), "user-activity")
    total = ua.agg(F.sum("total_upvotes").cast("double")).scalar()
    return (ua.where(F.col("total_upvotes") >= F.lit(min_upvotes))
            .select("author", "subreddit",
                    F.col("total_upvotes").cast("double").alias("total_upvotes"),
                    F.try_divide(F.col("total_upvotes").cast("double"), total).alias("topical_focus_score"),
                    F.round(F.log(F.col("post_count") + F.lit(1)), LOG_DIGITS).alias("activity_density"))
            .orderBy(F.col("topical_focus_score").desc_nulls_last()))


def utility_hits(posts: DataFrame, keywords) -> DataFrame:
    """Number of posts per (author, subreddit) whose body contains any keyword.

    A post counts once however many keywords it contains; keys without a hit
    are absent; NULL author or subreddit stay NULL (own group).
    """
    return (posts.where(has_any_keyword("body", keywords))
            .groupBy("author", "subreddit")
            .agg(F.count(F.lit(1)).alias("utility_hit")))


def enrich_posts(posts: DataFrame, reputation: DataFrame, utility: DataFrame) -> DataFrame:
    """Attach author signals to posts.

    ``expertise_score`` = topical focus of the post's (author, subreddit),
    ``utility_score`` = its utility hit count; missing keys give 0.
    """
    return (posts.join(author_signals(reputation, utility), ["author", "subreddit"], "left")
            .withColumn("expertise_score", F.coalesce(F.col("_focus"), F.lit(0.0)))
            .withColumn("utility_score", F.coalesce(F.col("_hits").cast("double"), F.lit(0.0)))
            .drop("_focus", "_hits"))


def author_signals(reputation: DataFrame, utility: DataFrame) -> DataFrame:
    """One row per (author, subreddit) with ``_focus`` and ``_hits`` (NULL where a signal is absent).

    It is written once: read back, it meets the posts through an exchange of
    its own, which is what lets AQE split the posts of a hot key.
    """
    rep = reputation.select("author", "subreddit", F.col("topical_focus_score").alias("_focus"),
                            F.lit(None).cast("bigint").alias("_hits"))
    util = utility.select("author", "subreddit", F.lit(None).cast("double").alias("_focus"),
                          F.col("utility_hit").alias("_hits"))
    both = rep.unionByName(util).groupBy("author", "subreddit")
    return write_shared(both.agg(F.max("_focus").alias("_focus"), F.max("_hits").alias("_hits")), "author-signals")


def head_row(df: DataFrame, tie_break: list[str]) -> DataFrame:
    """First row of a ranked result (T5); ``tie_break`` makes the pick deterministic."""
    return (df.orderBy(F.col("topical_focus_score").desc_nulls_last(), *tie_break).limit(1))
