"""Session construction and shared-storage helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC timestamps, AQE (coalescing + skew join),
# dynamic partition overwrite for idempotent re-runs of touched partitions.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "ledgerlake",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's required settings.

    On a cluster ``master`` is left to spark-submit; ``shuffle_partitions``
    should then be sized so that one shuffle partition is ~128-256 MB.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in CORE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_session_conf(spark: SparkSession) -> None:
    """Apply the settings results depend on to a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int):
    """Shuffle partitions by the rows at hand, for a step that runs at once.  They aren't merged to the
    advisory size, which counts compressed bytes: of short rows that is several millions a task."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in names]
    for k, v in zip(names, (str(n), "false"), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in zip(names, old, strict=True):
            spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, whose tasks
    share the driver's disk, gets a private temporary folder where it is unset; on a cluster
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects the steps'
    plans as garbage, which by itself may come long after the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder whose tables nobody reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder under a new name, at once; one that isn't there (nothing was written) comes as an empty one."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not (fs.rename(source, target) if fs.exists(source) else fs.mkdirs(target)):
        raise RuntimeError(f"{path} was not moved to {to}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
