"""Ranking evaluation for a whole table of queries.

All per-query work is windowed on ``query_id`` over at most ``k_recall``
candidates per query (bounded); averages are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevo.functions.arith import lift_pct
from relevo.functions.fixed import LATENCY_PERCENTILE, MIN_HITS_PER_QUERY, PROXY_RELEVANT_TOP
from relevo.operators.stats import exact_percentile

DIGITS = 9


def drop_thin_queries(df: DataFrame, min_hits: int = MIN_HITS_PER_QUERY) -> DataFrame:
    """Keep queries with at least ``min_hits`` candidates."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return df.withColumn("_n", n).where(F.col("_n") >= min_hits).drop("_n")


def proxy_relevance(cands: DataFrame, k: int = PROXY_RELEVANT_TOP) -> DataFrame:
    """Relevant = score at least the k-th best score (ties included) when a query
    has more than k hits; otherwise every hit is relevant (E1, W3)."""
    w = Window.partitionBy("query_id")
    kth = F.max(F.when(F.col("lex_rank") == k, F.col("score"))).over(w)
    n = F.count(F.lit(1)).over(w)
    rel = F.when(n > k, (F.col("score") >= kth).cast("int")).otherwise(F.lit(1))
    return cands.withColumn("rel", rel)


def _dcg(rel: str, rank: str):
    return F.sum(F.col(rel) / F.log2(F.col(rank) + F.lit(1)))


def per_query_metrics(ranked: DataFrame) -> DataFrame:
    """Per query: lexical nDCG, hybrid nDCG (E2, E4), recall flag.

    The ideal DCG uses the relevant items found, over the whole list; a
    query without a relevant item scores 0.
    """
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), F.col("lex_rank")))
    x = ranked.withColumn("_ideal", ideal)
    agg = x.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        _dcg("rel", "lex_rank").alias("_dl"), _dcg("rel", "hybrid_rank").alias("_dh"),
        _dcg("rel", "_ideal").alias("_di"), F.max("rel").alias("recall"))
    nd = lambda c: F.round(F.when(F.col("_di") > 0, F.col(c) / F.col("_di")).otherwise(F.lit(0.0)), DIGITS)
    return agg.select("query_id", "n_hits", nd("_dl").alias("lexical_ndcg"), nd("_dh").alias("hybrid_ndcg"),
                      "recall")


def summarize(per_query: DataFrame) -> DataFrame:
    """Mean nDCG of both rankings, lift in percent, recall in percent."""
    m = per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("lexical_ndcg").alias("l"),
                      F.avg("hybrid_ndcg").alias("h"), F.avg("recall").alias("r"))
    return m.select("n_queries", F.round("l", DIGITS).alias("lexical_ndcg"), F.round("h", DIGITS).alias("hybrid_ndcg"),
                    F.round(lift_pct("h", "l"), 6).alias("lift_pct"),
                    F.round(F.col("r") * F.lit(100.0), DIGITS).alias("recall_pct"))


def evaluate_rankings(ranked: DataFrame, k: int = PROXY_RELEVANT_TOP) -> DataFrame:
    """Proxy-label evaluation of lexical vs hybrid ranking."""
    return summarize(per_query_metrics(proxy_relevance(drop_thin_queries(ranked), k)))


def with_qrels(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Attach external judgements: ``rel`` = 1 when (query, doc) is judged relevant."""
    q = qrels.select("query_id", "doc_id", F.col("rel").alias("_rel")).distinct()
    return (ranked.join(q, ["query_id", "doc_id"], "left")
            .withColumn("rel", F.coalesce(F.col("_rel"), F.lit(0))).drop("_rel"))


def evaluate_qrels(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k and recall@k of both rankings against judged relevance.

    Every judged query counts (no hits = 0). The ideal ranking places
    ``min(k, #relevant)`` relevant documents first.
    """
    judged = qrels.where(F.col("rel") > 0).groupBy("query_id").agg(
        F.countDistinct("doc_id").alias("n_rel"))
    r = with_qrels(ranked, qrels)

    def at_k(rank):
        return F.sum(F.when(F.col(rank) <= k, F.col("rel") / F.log2(F.col(rank) + F.lit(1))))

    def found(rank):
        return F.sum(F.when(F.col(rank) <= k, F.col("rel")))

    got = r.groupBy("query_id").agg(at_k("lex_rank").alias("_dl"), at_k("hybrid_rank").alias("_dh"),
                                    found("lex_rank").alias("_fl"), found("hybrid_rank").alias("_fh"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel"))), F.lit(0.0),
                        lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))
    j = judged.join(got, "query_id", "left").withColumn("_di", ideal)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    per_q = j.select("query_id", "n_rel",
                     (z("_dl") / F.col("_di")).alias("lexical_ndcg"), (z("_dh") / F.col("_di")).alias("hybrid_ndcg"),
                     (z("_fl") / F.col("n_rel")).alias("lexical_recall"),
                     (z("_fh") / F.col("n_rel")).alias("hybrid_recall"))
    m = per_q.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("lexical_ndcg").alias("l"), F.avg("hybrid_ndcg").alias("h"),
                  F.avg("lexical_recall").alias("lr"), F.avg("hybrid_recall").alias("hr"))
    return m.select("n_queries", F.round("l", DIGITS).alias("lexical_ndcg"), F.round("h", DIGITS).alias("hybrid_ndcg"),
                    F.round(lift_pct("h", "l"), 6).alias("lift_pct"),
                    F.round(F.col("lr") * F.lit(100.0), DIGITS).alias("lexical_recall_pct"),
                    F.round(F.col("hr") * F.lit(100.0), DIGITS).alias("hybrid_recall_pct"))


def latency_summary(df: DataFrame, col: str = "latency_ms", p: float = LATENCY_PERCENTILE) -> DataFrame:
    """Row count and the exact ``p`` percentile (linear interpolation) of ``col``."""
    v = exact_percentile(df, col, p)
    n = df.where(F.col(col).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.lit(v).cast("double").alias(f"p{int(round(p * 100))}_ms"))
