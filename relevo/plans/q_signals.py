"""Registered queries: author signals, scans and predicates."""

from __future__ import annotations

from relevo.operators import signals as S
from relevo.plans.oracle_views import with_views
from relevo.plans.registry import register
from relevo.sources import tables as T

CUT = T.FIXTURE_CUTOFF
KW_SQL = " OR ".join(f"contains(lower(coalesce(body, '')), '{w}')" for w in T.FIXTURE_KEYWORDS)

_UA_SQL = f"""
    SELECT author, subreddit, COUNT(id) AS post_count, SUM(score) AS total_upvotes
    FROM activity WHERE created_utc < TIMESTAMP '{CUT}' AND author IS NOT NULL
    GROUP BY author, subreddit"""


@register("topical_reputation", with_views(f"""
    SELECT author, subreddit, CAST(total_upvotes AS DOUBLE) AS total_upvotes,
           CASE WHEN g.t = 0 THEN NULL ELSE CAST(total_upvotes AS DOUBLE) / g.t END AS topical_focus_score,
           round(ln(post_count + 1), 12) AS activity_density
    FROM ua, (SELECT CAST(SUM(total_upvotes) AS DOUBLE) AS t FROM ua) g
    WHERE total_upvotes >= 10
    ORDER BY topical_focus_score DESC""", "activity", extra=[("ua", _UA_SQL)]))
def q_topical_reputation(spark, sf_dir):
    return S.topical_reputation(T.activity(spark, sf_dir), CUT, 10)


@register("global_totals", with_views("""
    SELECT CAST(SUM(post_count) AS BIGINT) AS total_posts, CAST(SUM(total_upvotes) AS DOUBLE) AS total_global_upvotes
    FROM ua""", "activity", extra=[("ua", _UA_SQL)]))
def q_global_totals(spark, sf_dir):
    return S.global_totals(T.activity(spark, sf_dir), CUT)


@register("utility_hits", with_views(f"""
    SELECT author, subreddit, COUNT(*) AS utility_hit FROM posts
    WHERE {KW_SQL} GROUP BY author, subreddit""", "posts"))
def q_utility_hits(spark, sf_dir):
    return S.utility_hits(T.corpus(spark, sf_dir), T.FIXTURE_KEYWORDS)
