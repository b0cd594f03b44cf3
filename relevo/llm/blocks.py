"""Blocks of items that may be similar, dealt to tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevo.llm.components import components
from relevo.session import write_shared


def block_members(sharing: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` of every item that shares a key with another, roots included; written once."""
    found = components(sharing, a, b)
    return write_shared(found.union(found.select(F.col("root").alias("node"), "root").distinct()), "blocks")


def deal_blocks(items: DataFrame, member: DataFrame, item: str, weight: str, most: int) -> DataFrame:
    """``items`` (one row each) of a block with their ``root`` and ``pair``: the unit of work.

    A block of at most ``most`` in total weight is one unit. A heavier one is
    cut into parts by a hash of the item, and every pair of parts is a unit, so
    that each pair of items meets somewhere and no unit is much heavier than
    two parts.
    """
    placed = items.join(member, F.col(item) == F.col("node")).drop("node")
    parts = (placed.groupBy(F.col("root").alias("r"))
             .agg(F.ceil(F.sum(weight) / F.lit(most)).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64(item), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != mine)
    pairs = F.when(F.col("parts") <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(others, lambda q: F.struct(F.least(q, mine).alias("i"), F.greatest(q, mine).alias("j"))))
    return placed.join(parts, F.col("root") == F.col("r")).withColumn("pair", F.explode(pairs)).drop("r", "parts")
