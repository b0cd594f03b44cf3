"""Named queries of the package and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relevo.llm import (alignment, ctw, line_dedup, line_quality, packing, perspectives, piece_codec, prefix_join, ranked_search,
                        secret_tagger, sketch, token_store, url_filter)
from relevo.session import ensure_checkpoint_dir

_MODULES = (line_dedup, line_quality, piece_codec, packing, token_store, url_filter, ctw, sketch, prefix_join,
            perspectives, ranked_search, secret_tagger, alignment)


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir.rstrip("/"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {name: _prepared(fn) for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
