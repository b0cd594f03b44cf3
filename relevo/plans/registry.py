"""Named queries (Spark) and their independent SQL oracles (DuckDB).

Every query reads the driver's tables (or views Spark derives from them)
in full; none caps, samples or filters rows to keep checks cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relevo.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings every query relies on: UTC wall-clock timestamps (the
    fixtures store naive timestamps) and a checkpoint folder (the one the
    cluster names, or a scratch folder in local runs)."""
    from relevo.session import ensure_checkpoint_dir

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir.rstrip("/"))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    # query modules register themselves on import
    from relevo.plans import q_jobs, q_search, q_signals, q_tables  # noqa: F401


_load()

__all__ = ["QUERIES", "ORACLES", "register", "with_views"]
