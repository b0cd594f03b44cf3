"""Feature cleaning and normalisation.

Normalisation parameters are a one-row DataFrame; they reach the rows as
scalar subqueries (evaluated once, shipped as literals), never as a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.functions.arith import clip01
from relevo.functions.fixed import (DEFAULT_NORM_PARAMS, DEGENERATE_EXPERTISE_RANGE, DEGENERATE_UTILITY_RANGE,
                                    EPS_SERVE, EPS_TRAIN)
from relevo.operators.stats import exact_percentiles

PARAM_COLS = ("expertise_min", "expertise_max", "utility_min", "utility_max")
PARAM_SCHEMA = "expertise_min double, expertise_max double, utility_min double, utility_max double"


def drop_incomplete(df: DataFrame, cols=("body", "label")) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in any of ``cols``.

    A condition for each column: below a join it is tested where the column is
    read, so a text that is asked for no other reason is not shuffled.
    """
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("float", "double") else F.col(c).isNotNull())
    return df


def _finite(c: str):
    return F.when(~F.isnan(F.col(c)), F.col(c))


def feature_ranges(df: DataFrame, cols=("expertise_score", "utility_score")) -> DataFrame:
    """One row with ``<col>_min`` / ``<col>_max``; NULL and NaN skipped."""
    aggs = []
    for c in cols:
        aggs += [F.min(_finite(c)).alias(f"{c}_min"), F.max(_finite(c)).alias(f"{c}_max")]
    return df.agg(*aggs)


def fit_norm(df: DataFrame, expertise: str = "expertise_score", utility: str = "utility_score") -> DataFrame:
    """Fit min/max parameters before imputation.

    A column that is all-missing or constant gets the fixed fallback range
    (expertise [0, 1000], utility [0, 2]).
    """
    r = feature_ranges(df, (expertise, utility))

    def pick(lo, hi, default):
        bad = F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) == F.col(hi))
        return (F.when(bad, F.lit(default[0])).otherwise(F.col(lo)).cast("double"),
                F.when(bad, F.lit(default[1])).otherwise(F.col(hi)).cast("double"))

    e_lo, e_hi = pick(f"{expertise}_min", f"{expertise}_max", DEGENERATE_EXPERTISE_RANGE)
    u_lo, u_hi = pick(f"{utility}_min", f"{utility}_max", DEGENERATE_UTILITY_RANGE)
    return r.select(e_lo.alias("expertise_min"), e_hi.alias("expertise_max"),
                    u_lo.alias("utility_min"), u_hi.alias("utility_max"))


def params_frame(spark: SparkSession, params: dict | None = None) -> DataFrame:
    """A one-row parameter table from a dict (default: the no-file defaults)."""
    p = DEFAULT_NORM_PARAMS if params is None else params
    return spark.createDataFrame([tuple(float(p[c]) for c in PARAM_COLS)], PARAM_SCHEMA)


def impute_median(df: DataFrame, cols=("expertise_score", "utility_score")) -> DataFrame:
    """Fill missing values (NULL or NaN) with the column's exact median, or 0.0 if all missing.

    The medians of all columns are found in the same passes.
    """
    medians = exact_percentiles(df.select(*cols), dict.fromkeys(cols, 0.5))
    return df.withColumns({c: F.coalesce(_finite(c), F.lit(float(m or 0.0))) for c, m in medians.items()})


def apply_norm(df: DataFrame, params: DataFrame, mode: str = "serve",
               expertise: str = "expertise_score", utility: str = "utility_score",
               default: float | None = None) -> DataFrame:
    """Min-max scale both features with fitted parameters (N2 serve, N3 train).

    ``serve``: ε = 1e-6 and clipped to [0, 1]; ``train``: ε = 1e-10, no clip.
    ``default`` replaces a missing raw value first (serving reads 0.0 for a
    field a document does not have).
    """
    if mode not in ("serve", "train"):
        raise ValueError("mode must be 'serve' or 'train'")
    eps = EPS_SERVE if mode == "serve" else EPS_TRAIN
    p = {c: params.select(F.col(c).cast("double")).scalar() for c in PARAM_COLS}

    def scale(col, lo, hi):
        x = F.col(col) if default is None else F.coalesce(F.col(col).cast("double"), F.lit(default))
        y = (x - p[lo]) / (p[hi] - p[lo] + F.lit(eps))
        return clip01(y) if mode == "serve" else y

    return (df.withColumn(expertise, scale(expertise, "expertise_min", "expertise_max"))
              .withColumn(utility, scale(utility, "utility_min", "utility_max")))


def minmax_per_query(df: DataFrame, col: str = "score", partition: str = "query_id",
                     out: str = "lex_norm", eps: float = EPS_SERVE) -> DataFrame:
    """``(s - min) / (max - min + eps)`` within each query (N4, W2); one hit gives 0."""
    w = Window.partitionBy(partition)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, (F.col(col) - lo) / (hi - lo + F.lit(eps)))
