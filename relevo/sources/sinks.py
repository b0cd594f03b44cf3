"""Sinks: JSON posts, feature tables, keyed document upsert, parameters
(S6, S7, S11, S12). All writes go through Spark's commit protocol, so a
retried task never leaves partial files behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevo.operators.util import top_k
from relevo.session import write_shared

#: Keys with several rows up to which an upsert sends them to all tasks instead of shuffling every row.
FEW_KEYS = 100_000


def write_posts_json(df: DataFrame, path: str) -> str:
    """Posts as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def write_features(df: DataFrame, path: str, keys=("author", "subreddit"), mode: str = "overwrite_keys") -> str:
    """Feature table sink.

    ``append`` adds rows as they are (a re-run duplicates keys, like an
    append-only warehouse table); ``overwrite_keys`` (default) replaces the
    rows of the incoming keys and keeps the others; ``overwrite`` replaces
    the table. ``overwrite_keys`` writes a new version next to the old one
    and never reads and writes the same files in one job.
    """
    spark = df.sparkSession
    if mode in ("append", "overwrite"):
        df.write.mode(mode).parquet(path)
        return path
    if mode != "overwrite_keys":
        raise ValueError(f"unknown mode {mode}")
    current = latest_version(spark, path)
    merged = df
    if current is not None:
        merged = replace_keys(spark.read.parquet(current), df, keys)
    target = _next_version(spark, path, current)
    merged.write.mode("overwrite").parquet(target)
    return target


def replace_keys(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; a NULL in a key equals a NULL."""
    incoming = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    return old.join(incoming, same, "left_anti").unionByName(new)


def _versions(spark, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(hconf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(name)
    return sorted(out, key=lambda n: int(n[2:]))


def versions(spark, path: str) -> list[int]:
    """Numbers of the committed versions under ``path``, ascending."""
    return [int(n[2:]) for n in _versions(spark, path)]


def delete_path(spark, path: str) -> None:
    """Delete a folder of a sink that nothing refers to any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def latest_version(spark, path: str, below: int | None = None) -> str | None:
    v = _versions(spark, path)
    if below is not None:
        v = [n for n in v if int(n[2:]) < below]
    return f"{path.rstrip('/')}/{v[-1]}" if v else None


def next_version(spark, path: str) -> str:
    """Path of the version after the latest committed one."""
    return _next_version(spark, path, latest_version(spark, path))


def _next_version(spark, path: str, current: str | None) -> str:
    n = int(current.rsplit("v=", 1)[1]) + 1 if current else 0
    return f"{path.rstrip('/')}/v={n}"


def upsert_documents(existing: DataFrame | None, incoming: DataFrame, key: str = "id",
                     order: str = "ingest_seq") -> DataFrame:
    """Unique-key upsert (S11, W5): the row with the highest ``order`` per key wins.

    Of equal orders the incoming row wins, then the greatest remaining
    columns (deterministic). ``row_number() = 1`` is cut per map task before
    the shuffle, so a key with very many versions does not meet in one task.
    Keys are counted first: while at most ``FEW_KEYS`` have several rows, only
    these rows are shuffled, and all others stay where they are.
    """
    new = incoming.withColumn("_incoming", F.lit(1))
    allr = new if existing is None else existing.withColumn("_incoming", F.lit(0)).unionByName(new)
    rest = [c for c in incoming.columns if c not in (key, order)]
    repeated = write_shared(allr.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key"), "repeated-keys")

    def newest(df: DataFrame) -> DataFrame:
        best = top_k(df, 1, key, [F.col(order).desc_nulls_last(), F.col("_incoming").desc(),
                                  *[F.col(c).desc_nulls_last() for c in rest]], "_rank")
        return best.select(key, order, *rest)

    if repeated.count() > FEW_KEYS:
        return newest(allr)
    is_repeated = F.col(key).eqNullSafe(F.col("_key"))
    once = allr.join(F.broadcast(repeated), is_repeated, "left_anti").select(key, order, *rest)
    return once.unionByName(newest(allr.join(F.broadcast(repeated), is_repeated, "left_semi")))


def next_order(existing: DataFrame | None, order: str = "ingest_seq") -> int:
    """The order of a new run's rows: one above the highest stored."""
    top = existing.agg(F.max(order)).first()[0] if existing is not None else None
    return 0 if top is None else top + 1


def write_norm_params(params: DataFrame, path: str) -> str:
    """One-row parameter table as JSON."""
    params.coalesce(1).write.mode("overwrite").json(path)
    return path
