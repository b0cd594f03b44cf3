"""Relevance-model training on Spark ML (M1-M5).

The reference fine-tunes a neural re-ranker in one process and keeps the
epoch with the best validation log loss. Here the model is a Spark ML network
over features of the (query, document) pair, trained data-parallel; an epoch
is a few optimiser iterations from the last weights, and the epoch with the
best validation log loss is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevo.functions.fixed import EPOCHS, MODEL_VERSION, VAL_SPLIT
from relevo.functions.text import first_words, word_tokens

FEATURES = ["expertise_score", "utility_score", "coverage", "cosine", "log_body_len"]
SPLIT_MOD = 2147483647
SPLIT_MULT = 48271


def split_bucket(id_col="id", seed: int = 42):
    """A reproducible value in [0, 10000) per id (Park-Miller step on the id)."""
    x = ((F.col(id_col) % F.lit(SPLIT_MOD)) * F.lit(SPLIT_MULT) + F.lit(seed)) % F.lit(SPLIT_MOD)
    return x % F.lit(10000)


def split(df: DataFrame, val: float = VAL_SPLIT, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Mark a deterministic validation share (M1): ``is_validation`` per row.

    The assignment depends only on the id, so it is stable across runs and
    task retries (unlike a sampled split of a non-deterministic input order).
    """
    return df.withColumn("is_validation", split_bucket(id_col, seed) < F.lit(int(round(val * 10000))))


def training_pairs(df: DataFrame) -> DataFrame:
    """Training pairs (M2): query proxy = first 8 words of the body (tags kept),
    the body, both features and the label."""
    return df.select("id", first_words("body", 8).alias("query_text"), "body", "expertise_score",
                     "utility_score", "label")


def model_frame(pairs: DataFrame) -> DataFrame:
    """Numeric model inputs of ``(query_text, body)`` pairs: both features, the
    query's coverage by the body, the cosine of their term sets, and ``log(1 + body length)``."""
    q, d = F.array_distinct(word_tokens("query_text")), F.array_distinct(word_tokens(F.coalesce("body", F.lit(""))))
    both = F.size(F.array_intersect(q, d)).cast("double")
    share = lambda n: F.when(n > 0, both / n).otherwise(F.lit(0.0))
    return pairs.select("*", share(F.size(q)).alias("coverage"), share(F.sqrt(F.size(q) * F.size(d))).alias("cosine"),
                        log_length("body").alias("log_body_len")).withColumn("label", F.col("label").cast("double"))


def log_length(text: str):
    return F.log1p(F.length(F.coalesce(text, F.lit(""))).cast("double"))


def train_relevance_model(train_df: DataFrame, epochs: int = EPOCHS, val: float = VAL_SPLIT,
                          hidden: int | None = None, seed: int = 42, steps: int = 4):
    """Fit the relevance model epoch by epoch and keep the best by validation log loss (M3).

    Each epoch continues from the last one's weights for ``steps`` optimiser
    iterations over all training rows; ``hidden`` adds a hidden layer (without
    it the network is a logistic regression). Inputs must be complete
    (missing features imputed): a missing one raises.

    Returns ``(best_model, report)`` where ``report`` is a DataFrame of
    ``(epoch, train_loss, val_log_loss, kept)``.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    data = split(model_frame(train_df), val, seed).checkpoint(eager=True)
    tr, va = data.where(~F.col("is_validation")), data.where(F.col("is_validation"))
    evaluator = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label",
                                                  probabilityCol="probability")
    scale = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="raw", handleInvalid="error"),
                             MinMaxScaler(inputCol="raw", outputCol="features")]).fit(tr)
    scaled, held = scale.transform(tr), scale.transform(va)
    layers = [len(FEATURES), *([hidden] if hidden else []), 2]
    results, best, weights = [], None, None
    for epoch in range(1, epochs + 1):
        net = MultilayerPerceptronClassifier(layers=layers, maxIter=steps, seed=seed, tol=0.0)
        model = (net if weights is None else net.setInitialWeights(weights)).fit(scaled)
        weights = model.weights
        loss = float(evaluator.evaluate(model.transform(held)))
        results.append((epoch, float(model.summary().objectiveHistory[-1]), loss))
        if best is None or loss < best[1]:
            best = (model, loss, epoch)
    report = train_df.sparkSession.createDataFrame(
        [(*r, r[0] == best[2]) for r in results], "epoch int, train_loss double, val_log_loss double, kept boolean")
    return PipelineModel([*scale.stages, best[0]]), report


def training_report(report: DataFrame) -> DataFrame:
    """Losses per epoch in order, with the best validation loss so far (M4)."""
    best = F.min("val_log_loss").over(Window.orderBy("epoch"))  # a row per epoch
    return report.select("epoch", "train_loss", "val_log_loss", best.alias("best_so_far"), "kept").orderBy("epoch")


def save_model(model, path: str, version: str = MODEL_VERSION) -> str:
    """Persist the pipeline model under a versioned name (M5)."""
    target = f"{path.rstrip('/')}/relevance_ranker_v{version}"
    model.write().overwrite().save(target)
    return target
