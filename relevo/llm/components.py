"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevo.session import write_shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link other than the roots; ``root`` is the smallest id of the component.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours to their smallest, until nothing changes: the
    rounds grow with the logarithm of the longest path. Minima are combined
    before the shuffle. Every round is written to the shared folder, so a lost
    executor costs one round. Null ends and self-links are ignored.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return (df.where("hi IS NOT NULL AND lo IS NOT NULL AND hi <> lo")
                .select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()

    edges = write_shared(tidy(links.select(F.col(a).alias("hi"), F.col(b).alias("lo"))), "links")
    before = state(edges)
    while before[0]:
        ends = edges.union(edges.select("lo", "hi")).groupBy("hi").agg(F.min("lo").alias("m"))
        nearest = ends.select(F.col("hi").alias("u"), F.least("hi", "m").alias("m"))
        large = tidy(edges.join(nearest, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")))
        large = write_shared(large, "links")
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(least, F.col("hi") == F.col("u"))
        small = tidy(joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                     .union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))))
        edges = write_shared(small, "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
