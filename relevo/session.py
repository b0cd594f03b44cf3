"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Timestamps are compared against literal
# cut-offs, so the session time zone is pinned to UTC.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Codec of the intermediate tables and of what the pipeline writes.
COMPRESSION = "zstd"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "relevo", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster, ``master`` is left unset and the launcher decides; the
    shuffle-partition count should then be sized to the data (AQE coalesces
    small partitions, so over-provisioning is cheap).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there; it is used as is.
    Only when the setting is absent on a local master (tests) a fresh scratch
    folder is created and registered; on a cluster that is an error, since
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="relevo-ckpt-", dir=os.environ.get("RELEVO_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])


#: Makes Spark remove what a query has shuffled when the query ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _lock = [], threading.Lock()


@contextmanager
def _cleaned(spark: SparkSession):
    """Queries planned inside have ``CLEANUP``; the setting is as it was when the last of several threads leaves."""
    with _lock:
        _writing.append(spark.conf.get(CLEANUP, None) if not _writing else _writing[0])
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            was = _writing.pop()
            if not _writing:
                spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def write_shared(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and return
    the re-read table: cuts the lineage like ``checkpoint()`` but keeps a
    columnar, vectorised, prunable copy. What the write has shuffled goes with
    its end: the written copy is all that is read again."""
    spark = df.sparkSession
    path = shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex[:16]}")
    with _cleaned(spark):
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
