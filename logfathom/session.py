"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from logfathom.model import keep_filters_above

# Settings the results depend on; all are changeable at run time.
RUNTIME_CONF = {
    # naive timestamps are UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated key keeps its last value, in maps and in JSON objects
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # a hot partition is split at run time, small ones are merged
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM does not compile methods above this size; wide projections then
    # run operator by operator, in many small methods, which is faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Rows that one task parses, where rows are to be spread.
ROWS_PER_TASK = 100_000
# Bytes of files that a task reads at least, however small the splits are.
TASK_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def builder(app: str = "logfathom") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in RUNTIME_CONF.items():
        b = b.config(key, value)
    return b


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a session on one machine may name none; a local temporary folder is
    used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not on_one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="logfathom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/logfathom/{label}-{uuid.uuid4().hex}"


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_uri(spark: SparkSession, path: str) -> str:
    """A path as a full URI; one without a scheme is of the cluster's default store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = store.makeQualified(target).toUri().toString()  # signs encoded
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False if nothing was there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def cut_lineage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and
    safe from the loss of an executor. Who names the ``path`` may remove it."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The files of shuffles go when the write that needed them ends, and not when
    the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def spread(df: DataFrame, grow: bool = True) -> DataFrame:
    """Use all cores on an input too small to be split into as many tasks.

    Parsing is bound by the processor, and a scan is split by its stored bytes,
    of which a row of numbers has few. So there are as many tasks as bounded
    numbers of rows (with ``grow``) and at least as many as cores. A scan with
    as many tasks stays as it is, without a shuffle.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if grow:
        tasks = max(tasks, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def gathered(df: DataFrame) -> DataFrame:
    """A scan of files in fewer tasks, where the session's splits are small: a task
    then reads several of them. The splits and their order stay as they are.
    Filters and joins stay above, else each split would set up a join anew."""
    conf = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    split = conf.byteStringAsBytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    if split >= TASK_BYTES:
        return df
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return keep_filters_above(df.coalesce(max(min(splits, cores), -(-splits * split // TASK_BYTES))))
