"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on; the cluster may add to them.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # PySpark otherwise walks the Python stack on every Column call to
    # record call sites for error messages; the rule compiler makes a few
    # hundred such calls per table.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "hirelake",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python tasks find it
    wherever the driver was started.  Once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_hirelake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hirelake-zip-"), "hirelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("hirelake", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._hirelake_shipped = True


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a folder every "
            "executor can reach (HDFS, S3, ...) before running jobs that "
            "write intermediate tables")
    # Local runs and tests only: a private folder on this machine.
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="hirelake-ckpt-"))
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint directory.

    Intermediate tables, stream checkpoints and backups made by the
    registered queries live here, so they survive executor loss and are
    visible to every executor.
    """
    root = _checkpoint_root(spark).rstrip("/")
    return f"{root}/hirelake/{name}-{uuid.uuid4().hex[:12]}"


# Folders that ``materialize`` wrote, by open scope.
_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete on exit what ``materialize`` writes inside: for jobs whose
    results are all written out by then, such as a stream's micro-batch."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def materialize(df, label: str, partition_by: str | None = None):
    """Write ``df`` once as Parquet under the checkpoint folder and read it
    back: lineage is cut, a lost executor does not recompute the input, and
    later passes read columnar files.

    Preferred over ``DataFrame.checkpoint()``, which evaluates the plan
    twice (once to count, once to write) unless the data is also cached.
    ``partition_by`` lays the files out by one column, so later filters on
    it read only their own folders."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    if _scopes:
        _scopes[-1].append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df):
    """Round-robin ``df`` over the cluster's cores when it has fewer
    partitions than cores (a single small or unsplittable input file).

    Meant for CPU-heavy per-row work such as JSON parsing.  A large input
    already has more splits than cores, so this adds no shuffle there.
    Call it on a scan: reading the partition count of a plan that contains
    an adaptive shuffle would run that shuffle."""
    from pyspark.sql import DataFrame  # noqa: F401 - typing only
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark, path: str) -> bool:
    """Whether ``path`` exists on its file system (HDFS, S3, local, ...)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def read_text(spark, path: str) -> str:
    """A small text file (a table state), whole."""
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        raw = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
    finally:
        stream.close()
    return bytes(raw).decode()


def write_text(spark, path: str, text: str) -> None:
    """Write a small text file so that it appears whole or not at all: to a
    hidden name first, then renamed.  Fails if ``path`` exists."""
    p, fs = _fs(spark, path)
    hidden = p.suffix(f".{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(hidden, p):
        fs.delete(hidden, False)
        raise FileExistsError(f"{path} exists: another writer was faster")


def delete_path(spark, path: str) -> None:
    """Delete a file or folder."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def list_names(spark, path: str) -> list[str] | None:
    """Names of the entries directly under ``path`` (one shallow listing on
    the driver); ``None`` when the folder does not exist."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    return [st.getPath().getName() for st in fs.listStatus(p)]
