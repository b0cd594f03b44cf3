"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _row_number(df: DataFrame, partition, order, name: str) -> DataFrame:
    part = [partition] if isinstance(partition, str) else list(partition)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def let(value, body):
    """``body(value)`` with ``value`` computed once per row (a lambda variable:
    the optimizer cannot inline it where a nested lambda would repeat it)."""
    return F.transform(F.array(value), body)[0]


def rank_within(df: DataFrame, partition: list[str] | str, order: list, name: str = "rank") -> DataFrame:
    """1-based ``row_number`` (as bigint) within ``partition`` by ``order``."""
    return _row_number(df, partition, order, name).withColumn(name, F.col(name).cast("long"))


def top_k(df: DataFrame, k: int, partition: list[str] | str, order: list, name: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each partition.

    ``row_number() <= k`` lets Catalyst plan a ``WindowGroupLimit``: each map
    task keeps at most k rows per partition key before the shuffle, so a key
    with a huge candidate set is cut down where it is produced.
    """
    # filter on the raw row_number (the pattern the planner recognises), widen after
    return (_row_number(df, partition, order, name).where(F.col(name) <= k)
            .withColumn(name, F.col(name).cast("long")))


#: Tables up to this size are hash-spread before text work.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a small table over the cores.

    A file with one large row group is read by a single task, which
    serialises text work. Tables estimated at more than ``SPREAD_BYTES`` are
    returned as they are: their scan has splits of its own, and shuffling
    their texts would cost more.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
