"""Pair scoring (SC1-SC4).

The re-ranker of a (query, document) pair is pluggable:
- a ``Column`` function of the pair's columns (default: a logistic model
  over native pair features; runs inside code generation),
- a fitted Spark ML model (``model.transform``),
- a pandas batch function run with ``mapInPandas`` (weights loaded once per
  Python worker, Arrow batches).
No neural weights ship with the reference, so there is no score parity with
its encoder; see ``pair_features`` for what stands in for it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevo.functions.arith import sigmoid
from relevo.functions.fixed import LAYER_NORM_EPS

SCORE_DIGITS = 9

# [ours] default logistic weights over (coverage, expertise, utility)
DEFAULT_WEIGHTS = {"bias": -2.0, "coverage": 3.0, "expertise_score": 1.0, "utility_score": 1.0}


def logistic_scorer(weights: dict | None = None) -> Callable[[DataFrame], Column]:
    """``sigmoid(bias + sum_i w_i * x_i)`` as a Column function."""
    w = DEFAULT_WEIGHTS if weights is None else weights

    def score(_df: DataFrame) -> Column:
        z = F.lit(float(w.get("bias", 0.0)))
        for name, weight in w.items():
            if name != "bias":
                z = z + F.lit(float(weight)) * F.col(name)
        return sigmoid(z)

    return score


def pair_features(cands: DataFrame) -> DataFrame:
    """Native pair features (SC2): ``coverage`` = matched query terms / query terms; where the document's
    ``n_doc_terms`` is given, ``cosine`` of the two term sets; where its length ``dl`` is given, ``log_length``."""
    out = cands.withColumn("coverage", F.col("matched").cast("double") / F.col("n_query_terms"))
    if "n_doc_terms" in cands.columns:
        size = F.sqrt(F.col("n_query_terms") * F.col("n_doc_terms"))
        out = out.withColumn("cosine", F.when(size > 0, F.col("matched") / size).otherwise(F.lit(0.0)))
    return out.withColumn("log_length", F.log(F.col("dl") + F.lit(1.0))) if "dl" in cands.columns else out


def score_pairs(cands: DataFrame, scorer, out: str = "semantic", output_schema: str | None = None) -> DataFrame:
    """Score every pair (SC1).

    ``scorer`` is a Column function, a fitted Spark ML model exposing
    ``transform`` (its ``probability[1]`` becomes ``out``), or a pandas
    function ``f(pdf) -> pd.Series`` run batch-wise through ``mapInPandas``.
    """
    if hasattr(scorer, "transform"):
        scored = scorer.transform(cands)
        from pyspark.ml.functions import vector_to_array

        prob = vector_to_array(F.col("probability")).getItem(1)
        drop = [c for c in ("raw", "rawPrediction", "probability", "prediction", "features") if c in scored.columns
                and c not in cands.columns]
        return scored.withColumn(out, F.round(prob, SCORE_DIGITS)).drop(*drop)
    if getattr(scorer, "pandas_batch", False):
        schema = output_schema or (cands.schema.simpleString()[len("struct<"):-1] + f",{out}:double")

        def run(batches):
            for pdf in batches:
                pdf[out] = np.round(np.asarray(scorer(pdf), dtype="float64"), SCORE_DIGITS)
                yield pdf

        return cands.mapInPandas(run, schema)
    return cands.withColumn(out, F.round(scorer(cands), SCORE_DIGITS))


def pandas_scorer(fn):
    """Mark ``fn(pdf) -> array`` as a batch scorer for ``score_pairs``."""
    fn.pandas_batch = True
    return fn


def layer_norm(a: str, b: str, eps: float = LAYER_NORM_EPS, gamma=(1.0, 1.0), beta=(0.0, 0.0),
               out=("ln_a", "ln_b")):
    """LayerNorm over two feature columns (SC4): ``(x - mean) / sqrt(var_pop + eps)``."""
    x, y = F.col(a), F.col(b)
    mean = (x + y) / F.lit(2.0)
    var = ((x - mean) * (x - mean) + (y - mean) * (y - mean)) / F.lit(2.0)
    den = F.sqrt(var + F.lit(eps))
    return [((x - mean) / den * F.lit(gamma[0]) + F.lit(beta[0])).alias(out[0]),
            ((y - mean) / den * F.lit(gamma[1]) + F.lit(beta[1])).alias(out[1])]


def fusion_head(df: DataFrame, vec_col: str, feat_cols: list[str], weights: dict, out: str = "logit") -> DataFrame:
    """Fusion head over precomputed text vectors (SC3), batch-wise in NumPy.

    ``weights``: ``W1 (h, d), b1 (h), W2 (m, h + f), b2 (m), W3 (1, m), b3 (1)``
    plus optional LayerNorm ``gamma``/``beta`` (f). Text branch
    ``relu(W1 v + b1)``, features LayerNorm-ed, concatenated,
    ``relu(W2 . + b2)``, then ``W3 . + b3``. Dimensions come from the weights.
    """
    sc = df.sparkSession.sparkContext
    bw = sc.broadcast({k: np.asarray(v, dtype="float64") for k, v in weights.items()})
    schema = df.schema.simpleString()[len("struct<"):-1] + f",{out}:double"

    def run(batches):
        w = bw.value
        for pdf in batches:
            v = np.stack(pdf[vec_col].map(lambda a: np.asarray(a, dtype="float64")).to_numpy()) \
                if len(pdf) else np.zeros((0, w["W1"].shape[1]))
            h = np.maximum(v @ w["W1"].T + w["b1"], 0.0)
            f = pdf[feat_cols].to_numpy(dtype="float64")
            mu = f.mean(axis=1, keepdims=True)
            var = f.var(axis=1, keepdims=True)
            f = (f - mu) / np.sqrt(var + LAYER_NORM_EPS) * w.get("gamma", 1.0) + w.get("beta", 0.0)
            z = np.maximum(np.concatenate([h, f], axis=1) @ w["W2"].T + w["b2"], 0.0)
            pdf[out] = (z @ w["W3"].T + w["b3"]).reshape(-1)
            yield pdf

    return df.mapInPandas(run, schema)
