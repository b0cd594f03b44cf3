"""Data-quality diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions.fixed import (CANARIES, CANARY_DEFAULT_MIN, CANARY_RELEVANT_MIN, IMBALANCE_SEVERE,
                                    LOW_VARIANCE_STD, SCALE_MISMATCH_AVG)

DIGITS = 12


def label_stats(df: DataFrame, e: str = "expertise_score", u: str = "utility_score") -> DataFrame:
    """Per label: count, mean and sample standard deviation of both features."""
    r = lambda c: F.round(c, DIGITS)
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("count"),
        r(F.avg(e)).alias("avg_expertise"), r(F.avg(u)).alias("avg_utility"),
        r(F.stddev_samp(e)).alias("std_expertise"), r(F.stddev_samp(u)).alias("std_utility"))


def class_imbalance(df: DataFrame) -> DataFrame:
    """``max(c0, c1) / (min(c0, c1) + 1)`` when more than one label value exists.

    A missing class counts 0. ``severe`` when the ratio exceeds 10. With a
    single label value the ratio is NULL (not computed).
    """
    a = df.agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"),
               F.countDistinct(F.col("label")).alias("n_labels"),
               F.max(F.col("label").isNull().cast("int")).alias("has_null"))
    groups = F.col("n_labels") + F.coalesce(F.col("has_null"), F.lit(0))
    ratio = F.when(groups > 1, F.greatest("c0", "c1") / (F.least("c0", "c1") + F.lit(1)).cast("double"))
    return a.select("c0", "c1", F.round(ratio, DIGITS).alias("imbalance_ratio"),
                    (F.coalesce(ratio, F.lit(0.0)) > F.lit(IMBALANCE_SEVERE)).alias("severe"))


def feature_stats(df: DataFrame, offset: int = 0, limit: int | None = None,
                  e: str = "expertise_score", u: str = "utility_score") -> DataFrame:
    """Mean, sample std and NULL counts of both features over ``label = 1`` rows.

    The optional sample window (``offset``/``limit`` over rows ordered by id)
    is applied *before* aggregating.
    """
    x = df.where(F.col("label") == 1)
    if offset or limit is not None:
        x = x.orderBy("id")
        if offset:
            x = x.offset(offset)
        if limit is not None:
            x = x.limit(limit)
    r = lambda c: F.round(c, DIGITS)
    return x.agg(r(F.avg(e)).alias("avg_expertise"), r(F.stddev_samp(e)).alias("std_expertise"),
                 r(F.avg(u)).alias("avg_utility"), r(F.stddev_samp(u)).alias("std_utility"),
                 F.count_if(F.col(e).isNull()).alias("null_expertise"),
                 F.count_if(F.col(u).isNull()).alias("null_utility"),
                 F.count(F.lit(1)).alias("n_rows"))


def canary_frame(spark: SparkSession) -> DataFrame:
    """The three fixed canary pairs (D3)."""
    return spark.createDataFrame(CANARIES, "canary string, query_text string, body string, "
                                           "expertise_score double, utility_score double")


def diagnose(df: DataFrame, canary_scores: DataFrame | None = None) -> DataFrame:
    """Findings table ``(check, value, threshold, failed)``.

    Checks: class imbalance > 10, no evaluation rows, low variance of either
    feature (< 0.1) in the evaluation rows, training-scale mismatch (mean of
    per-label expertise means > 10) and, when canary scores are given, the
    relevant canary < 0.5 and the default-feature canary < 0.3.
    """
    # one pass: counts per class, the evaluation rows' statistics, and one sum and count per label value
    label, e, u = F.col("label"), F.col("expertise_score"), F.col("utility_score")
    r = lambda c: F.round(c, DIGITS)
    per_label = df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(e)).alias("avg_e"), r(F.stddev_samp(e)).alias("std_e"),
        r(F.stddev_samp(u)).alias("std_u"))
    of = lambda v, c: F.coalesce(F.max(F.when(label == v, F.col(c))), F.lit(0))
    a = per_label.agg(of(0, "n").alias("c0"), of(1, "n").alias("c1"), F.count(F.lit(1)).alias("groups"),
                      F.max(F.when(label == 1, F.col("std_e"))).alias("std_e"),
                      F.max(F.when(label == 1, F.col("std_u"))).alias("std_u"), r(F.avg("avg_e")).alias("scale"))
    ratio = F.when(F.col("groups") > 1, F.greatest("c0", "c1") / (F.least("c0", "c1") + F.lit(1)).cast("double"))

    def finding(name, value, threshold, failed):
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"),
                        F.lit(threshold).cast("double").alias("threshold"),
                        F.coalesce(failed, F.lit(False)).alias("failed"))

    checks = F.array(
        finding("class_imbalance", r(ratio), IMBALANCE_SEVERE, ratio > IMBALANCE_SEVERE),
        finding("no_eval_data", F.col("c1"), 0.0, F.col("c1") == 0),
        finding("low_variance_expertise", F.col("std_e"), LOW_VARIANCE_STD, F.col("std_e") < LOW_VARIANCE_STD),
        finding("low_variance_utility", F.col("std_u"), LOW_VARIANCE_STD, F.col("std_u") < LOW_VARIANCE_STD),
        finding("feature_scale_mismatch", F.col("scale"), SCALE_MISMATCH_AVG, F.col("scale") > SCALE_MISMATCH_AVG))
    out = a.select(F.explode(checks).alias("f")).select("f.*")
    if canary_scores is not None:
        th = F.when(F.col("canary") == "relevant_high_features", F.lit(CANARY_RELEVANT_MIN)) \
              .when(F.col("canary") == "relevant_default_features", F.lit(CANARY_DEFAULT_MIN))
        c = canary_scores.where(th.isNotNull()).select(
            F.concat(F.lit("canary_"), F.col("canary")).alias("check"), F.col("semantic").alias("value"),
            th.alias("threshold"), (F.col("semantic") < th).alias("failed"))
        out = out.unionByName(c)
    return out


def sample_counts(df: DataFrame) -> DataFrame:
    """Loaded rows, rows kept by cleaning (body and label present), and rows per class."""
    return df.agg(F.count(F.lit(1)).alias("loaded"),
                  F.count_if(F.col("body").isNotNull() & F.col("label").isNotNull()).alias("cleaned"),
                  F.count_if(F.col("label") == 0).alias("class_0"),
                  F.count_if(F.col("label") == 1).alias("class_1"))
