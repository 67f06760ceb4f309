"""Session helpers: one place for the settings the operators assume."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators rely on. AQE is what turns a sort-merge join into a
# broadcast join once the real size of a side is known, coalesces small
# shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "furlong",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage that all executors share. Only a
    local master may go without it (a laptop, a unit test): there a private
    temporary folder is used. Anywhere else a missing setting is an error, as
    each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name shared storage on master {sc.master}")
        path = tempfile.mkdtemp(prefix="furlong-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str):
    """A session setting for the plans that run within this block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Within this block the shuffle files of a plan go when it ends. Else they
    stay until the driver's JVM happens to collect the plan, which on a cluster
    may be after the job. For plans that run once, as a write does."""
    with session_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path for written intermediates: a folder of this application under the
    shared checkpoint folder, deleted when the application's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    root = os.path.join(base, "furlong", spark.sparkContext.applicationId)
    if root not in _SCRATCH:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _SCRATCH.add(root)
    return os.path.join(root, *parts)


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: cuts the lineage like ``checkpoint()`` (the written files
    survive executor loss), but later reads are vectorised and column-pruned.
    What the plan shuffled goes when it is written."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    with brief_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
