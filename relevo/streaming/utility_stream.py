"""Continuous utility counter.

``readStream`` over a directory/glob of post files -> keyword predicate ->
running count per (author, subreddit) in the state store -> ``update``
output mode -> ``foreachBatch`` keyed overwrite into a bucketed table.

The sink's rows lie in buckets by a hash of the key. Each micro-batch carries
the new totals of the keys it touched; only the buckets of those keys are
written anew (``data/v=N/bucket=B``), and a manifest (``manifest/v=N``: the
version that holds each bucket, and the stream and epoch that wrote it) makes
them current. A stream is known by an id kept beside its checkpoint, so a
replayed epoch starts from the manifest before its own attempt, while a new
checkpoint over an old sink goes on from the newest one: its totals replace
the old ones. Files that the last two manifests do not name are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions.text import has_any_keyword
from relevo.session import path_exists
from relevo.sources.sinks import delete_path, latest_version, replace_keys, versions

KEYS = ("author", "subreddit")
BUCKETS = 64
_MANIFEST = "bucket int, version bigint, stream string, epoch bigint"


def utility_counts(posts: DataFrame, keywords) -> DataFrame:
    return (posts.where(has_any_keyword("body", keywords))
            .groupBy("author", "subreddit").agg(F.count(F.lit(1)).alias("utility_hit")))


def _bucket(n: int):
    return F.pmod(F.xxhash64(*KEYS), F.lit(n)).cast("int")


def _manifest(spark: SparkSession, sink: str, below: int | None = None):
    """``(number, {bucket: version}, stream, epoch)`` of the newest manifest (below a number); None without one."""
    path = latest_version(spark, f"{sink}/manifest", below)
    if path is None:
        return None
    rows = spark.read.schema(_MANIFEST).parquet(path).collect()  # a row a bucket, and one for the sink itself
    of = {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}
    return int(path.rsplit("v=", 1)[1]), of, rows[0]["stream"], rows[0]["epoch"]


def _rows(spark: SparkSession, sink: str, held: dict[int, int], schema) -> DataFrame:
    paths = [f"{sink}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _merge_batch(sink: str, stream: str, buckets: int):
    def merge(batch: DataFrame, epoch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        last = _manifest(spark, sink)
        if last and (last[2], last[3]) == (stream, epoch_id):  # a replay: as if its own attempt had not been
            number, last = last[0], _manifest(spark, sink, below=last[0])
        else:
            number = last[0] + 1 if last else 0
        held = last[1] if last else {}
        batch = batch.withColumn("bucket", _bucket(buckets)).persist()
        try:
            touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
            old = _rows(spark, sink, {b: v for b, v in held.items() if b in touched}, schema).withColumn("bucket", _bucket(buckets))
            if touched:
                (replace_keys(old, batch, KEYS).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
                 .parquet(f"{sink}/data/v={number}"))
        finally:
            batch.unpersist()
        now = {**held, **dict.fromkeys(touched, number)}
        rows = [(b, v, stream, epoch_id) for b, v in sorted(now.items())] + [(-1, buckets, stream, epoch_id)]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{sink}/manifest/v={number}")
        _clean(spark, sink, number, set(now.values()) | set(held.values()))
    return merge


def _clean(spark: SparkSession, sink: str, number: int, named: set[int]) -> None:
    for v in versions(spark, f"{sink}/data"):
        if v < number and v not in named:
            delete_path(spark, f"{sink}/data/v={v}")
    for v in versions(spark, f"{sink}/manifest"):
        if v < number - 1:
            delete_path(spark, f"{sink}/manifest/v={v}")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint, made with it."""
    path = f"{checkpoint.rstrip('/')}-stream-id"
    if not path_exists(spark, f"{path}/_SUCCESS") or not path_exists(spark, f"{checkpoint.rstrip('/')}/metadata"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "stream string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["stream"]


def stream_utility(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keywords,
                   to_posts=None, available_now: bool = True, file_glob: str | None = None, buckets: int = BUCKETS):
    """Start the streaming utility counter; returns the ``StreamingQuery``.

    ``source`` is a folder of parquet files (new files are picked up as they
    arrive); ``file_glob`` narrows it to matching file names.
    ``to_posts`` maps the raw stream to ``(author, subreddit, body)``.
    ``available_now`` processes everything present and stops (batch-like
    runs); otherwise the query keeps running with the default trigger.
    ``buckets`` is set when the sink is first written and read from it later.
    """
    sink = sink.rstrip("/")
    first = latest_version(spark, f"{sink}/manifest")
    if first is not None:
        buckets = spark.read.schema(_MANIFEST).parquet(first).where("bucket = -1").first()["version"]
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    raw = reader.parquet(source)
    posts = to_posts(raw) if to_posts else raw
    counts = utility_counts(posts, keywords)
    w = (counts.writeStream.outputMode("update").foreachBatch(_merge_batch(sink, _stream_id(spark, checkpoint), buckets))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_utility(spark: SparkSession, sink: str) -> DataFrame:
    """The current rows ``(author, subreddit, utility_hit)``."""
    schema = "author string, subreddit string, utility_hit bigint"
    last = _manifest(spark, sink.rstrip("/"))
    return _rows(spark, sink.rstrip("/"), last[1] if last else {}, schema)
