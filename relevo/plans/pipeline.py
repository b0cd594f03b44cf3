"""End-to-end job (Z1): [reputation, utility] -> enrichment -> documents -> index, parameters -> model.

One driver program replaces the daily DAG. Every stage writes its result to
the shared output folder and the next stage reads it back, so lineage is cut
at each stage boundary. The two signal stages do not depend on each other and
are submitted together. What a stage has written is recorded under
``_runs/<run>/<stage>`` when it is done: a run that is started again under its
name goes on after the last finished stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.config import Config
from relevo.operators import features as N
from relevo.operators import lexical as L
from relevo.operators import signals as G
from relevo.operators import training as M
from relevo.operators import vectors as V
from relevo.plans import search as S
from relevo.session import COMPRESSION, path_exists, write_shared
from relevo.sources import tables as T
from relevo.sources.readers import coerce_documents, read_norm_params
from relevo.sources.sinks import latest_version, next_order, next_version, upsert_documents, write_features, write_norm_params


class Stages:
    """Stages of one run; ``done`` gives the path that a finished stage recorded."""

    def __init__(self, spark: SparkSession, out: str, run: str):
        self.spark, self.folder = spark, f"{out}/_runs/{run}"

    def done(self, name: str) -> str | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path).first()["path"] if path_exists(self.spark, f"{path}/_SUCCESS") else None

    def __call__(self, name: str, work: Callable[[], str]) -> str:
        path = self.done(name)
        if path is None:
            path = work()
            self.spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return path


def run_pipeline(spark: SparkSession, sf_dir: str, out: str, cfg: Config | None = None,
                 keywords=None, cutoff: str = T.FIXTURE_CUTOFF, train: bool = True, run: str | None = None) -> DataFrame:
    """All stages over the tables in ``sf_dir``; returns the training table. ``run``: name under which a failed run resumes."""
    cfg = (cfg or Config()).validate()
    keywords = keywords or cfg.utility_keywords
    out = out.rstrip("/")
    stage = Stages(spark, out, run or uuid.uuid4().hex)

    def overwrite(df: DataFrame, path: str) -> str:
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
        return path

    # author signals: independent of each other
    def reputation() -> str:
        return overwrite(G.topical_reputation(T.posts_activity(spark, sf_dir), cutoff, cfg.min_upvote_threshold),
                         f"{out}/user_reputation")

    def utility() -> str:
        return write_features(G.utility_hits(T.corpus(spark, sf_dir), keywords), f"{out}/user_utility_features")

    with ThreadPoolExecutor(2) as pool:
        signals = [pool.submit(inheritable_thread_target(spark)(stage), name, work)
                   for name, work in (("reputation", reputation), ("utility", utility))]
        rep, util = (s.result() for s in signals)

    # enrichment join -> training table
    table = spark.read.parquet(stage("enrichment", lambda: overwrite(
        G.enrich_posts(T.posts(spark, sf_dir), spark.read.parquet(rep), spark.read.parquet(util)), f"{out}/training_set")))

    def documents() -> str:
        prev = latest_version(spark, f"{out}/documents")
        existing = spark.read.parquet(prev).drop("content_vector") if prev else None
        docs = coerce_documents(table).withColumn("ingest_seq", F.lit(next_order(existing)).cast("bigint"))
        target = next_version(spark, f"{out}/documents")
        merged = write_shared(upsert_documents(existing, docs), "upserted")
        return overwrite(V.embed(merged, "body", cfg.vector_dim, "content_vector"), target)

    store = stage("documents", documents)

    def index() -> str:
        docs = spark.read.parquet(store).select("id", "body")
        prev = latest_version(spark, f"{out}/documents", below=int(store.rsplit("v=", 1)[1]))
        if prev is None or latest_version(spark, f"{out}/index/stats") is None:
            return L.write_index(docs, f"{out}/index")
        # only documents that are new or whose text is another
        old = spark.read.parquet(prev).select(F.col("id").alias("_id"), F.xxhash64("body").alias("_h"))
        changed = docs.join(old, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("body") == F.col("_h")), "left_anti")
        return L.update_index(spark, f"{out}/index", write_shared(changed, "changed"))

    stage("index", index)
    clean = N.drop_incomplete(table, ("body", "label"))
    params = read_norm_params(spark, stage("parameters", lambda: write_norm_params(N.fit_norm(clean), f"{out}/feature_norm_params")))

    def model() -> str:
        normed = N.apply_norm(N.impute_median(clean), params, "train")
        fitted, report = M.train_relevance_model(M.training_pairs(normed), epochs=cfg.epochs, val=cfg.val_split)
        M.save_model(fitted, f"{out}/models", cfg.version)
        return overwrite(report, f"{out}/training_report")

    if train:
        stage("model", model)
    return table


def search_outputs(spark: SparkSession, out: str, queries: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Hybrid search over what the pipeline wrote: its index, documents and parameters, with the configuration's
    ``k_recall``, ``alpha`` and ``top_k``."""
    cfg, out = (cfg or Config()).validate(), out.rstrip("/")
    features = spark.read.parquet(latest_version(spark, f"{out}/documents")).select("id", "expertise_score", "utility_score")
    ranked = S.ranked_candidates(queries, None, features, read_norm_params(spark, f"{out}/feature_norm_params"),
                                 k_recall=cfg.k_recall, alpha=cfg.alpha, index=L.open_index(spark, f"{out}/index"))
    return ranked.where(F.col("hybrid_rank") <= cfg.top_k)
