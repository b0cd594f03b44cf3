"""Hybrid fusion and ranking comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevo.functions.arith import affine_blend
from relevo.functions.fixed import ALPHA, TOP_K
from relevo.operators.util import rank_within, top_k

SCORE_DIGITS = 9


def check_alpha(alpha: float) -> float:
    if not 0.0 <= float(alpha) <= 1.0:
        raise ValueError(f"alpha must lie in [0, 1], got {alpha}")
    return float(alpha)


def fuse(df: DataFrame, alpha: float = ALPHA, lexical: str = "lex_norm", semantic: str = "semantic",
         out: str = "hybrid") -> DataFrame:
    """``alpha * lexical + (1 - alpha) * semantic`` (H1)."""
    a = check_alpha(alpha)
    return df.withColumn(out, F.round(affine_blend(lexical, semantic, a), SCORE_DIGITS))


def hybrid_order():
    """Descending hybrid score; equal scores keep the lexical order (stable sort)."""
    return [F.col("hybrid").desc(), F.col("lex_rank").asc(), F.col("doc_id").asc()]


def rank_hybrid(df: DataFrame) -> DataFrame:
    return rank_within(df, "query_id", hybrid_order(), "hybrid_rank")


def rank_shift(lex_top: DataFrame, hyb_top: DataFrame) -> DataFrame:
    """Hybrid top-k with the document's displayed lexical position when it moved up.

    ``was_rank`` is the lexical rank if the document was shown in the lexical
    list at a worse position, else NULL.
    """
    lex = lex_top.select("query_id", "doc_id", F.col("lex_rank").alias("_shown_lex"))
    j = hyb_top.join(lex, ["query_id", "doc_id"], "left")
    return (j.withColumn("was_rank", F.when(F.col("_shown_lex") > F.col("hybrid_rank"), F.col("_shown_lex")))
            .drop("_shown_lex"))


def compare_rankings(ranked: DataFrame, k: int = TOP_K) -> DataFrame:
    """Side-by-side lexical and hybrid top-k with rank shift (H3).

    One row per document shown in either list: ``lex_rank``/``hybrid_rank``
    are the positions in each displayed list (NULL if not shown there).
    """
    lex_top = ranked.where(F.col("lex_rank") <= k)
    hyb_top = top_k(ranked, k, "query_id", hybrid_order(), "hybrid_rank")
    shifted = rank_shift(lex_top, hyb_top).select("query_id", "doc_id", "hybrid_rank", "was_rank")
    lex = lex_top.select("query_id", "doc_id", F.col("lex_rank").alias("shown_lex_rank"))
    return (lex.join(shifted, ["query_id", "doc_id"], "full")
            .select("query_id", "doc_id", F.col("shown_lex_rank").alias("lex_rank"), "hybrid_rank", "was_rank"))


def alpha_grid(df: DataFrame, alphas, lexical: str = "lex_norm", semantic: str = "semantic") -> DataFrame:
    """One copy of every row per alpha with its hybrid score (H4).

    The grid is a fixed literal array exploded per row (a generator, no join).
    """
    for a in alphas:
        check_alpha(a)
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    g = df.select("*", grid.alias("alpha"))
    h = F.col("alpha") * F.col(lexical) + (F.lit(1.0) - F.col("alpha")) * F.col(semantic)
    return g.withColumn("hybrid", F.round(h, SCORE_DIGITS))
