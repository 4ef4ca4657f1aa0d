"""Spark session helpers.

The library never builds its own cluster settings on top of a session it is
handed; ``get_spark`` is for scripts, tests and the bench. On a cluster the
session comes from the launcher and only the checkpoint directory is read
from it.
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that make the plans in this package behave as intended:
# AQE re-plans joins from measured sizes (broadcast only below the runtime
# threshold, i.e. a checked size) and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows after an aggregation are small in bytes but feed CPU-heavy text
    # work (rendering, regex extraction): do not coalesce them below 64 KB
    # per task, or a whole vendor's pages end up in one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A plan here has thousands of columns; noting the Python line of each takes longer than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


JIT_BYTES = 8000  # fixed value: HotSpot's HugeMethodLimit


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ledgerline", extra: dict | None = None) -> SparkSession:
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
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only where it is unset on a ``local`` master (one machine: scripts, tests)
    a fresh scratch folder takes its place. On a cluster, executors would each
    write to a disk of their own and later reads would miss those files, so
    an unset folder is an error there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="ledgerline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def row_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: a batch of whole texts must fit beside its neighbours in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def _write_table(df, name: str) -> str:
    import uuid

    path = ensure_checkpoint_dir(df.sparkSession).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df, name: str = "tbl"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a reliable checkpoint, but computes the plan once (an
    eager RDD checkpoint of an unpersisted plan runs it twice), and later
    reads get column pruning and filter pushdown on the written table.
    """
    return df.sparkSession.read.parquet(_write_table(df, name))


@contextmanager
def small_methods(spark: SparkSession):
    """While a wide plan runs: HotSpot interprets a method of over 8,000 bytes of code for good, so stages whose
    generated method is longer run as separate operators with methods of their own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), JIT_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def lean_disk(spark: SparkSession):
    """While a table is written: zstd instead of Snappy, and the shuffle files of its plan are deleted once it is written
    (they would stay until the driver happens to collect its garbage)."""
    lean = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in lean}
    for key, value in lean.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_MEMO: dict[tuple, str] = {}


def memo_table(spark: SparkSession, key: tuple, build):
    """A prepared table written once per session and reused.

    ``build()`` returns the DataFrame to prepare; its parquet copy in the
    shared checkpoint folder serves every later request for the same key
    (e.g. the page records of one data folder) within the application. The
    inputs are taken not to change meanwhile; ``forget_tables`` drops the
    copies, so that the next request builds them again.
    """
    full = (spark.sparkContext.applicationId,) + tuple(key)
    path = _MEMO.get(full)
    if path is None:
        df = build()
        with small_methods(spark), lean_disk(spark):
            path = _write_table(df, key[0])
        _MEMO[full] = path
    return spark.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget_tables(spark: SparkSession) -> None:
    """Drop this application's prepared tables and delete their files."""
    for key in [k for k in _MEMO if k[0] == spark.sparkContext.applicationId]:
        delete_path(spark, _MEMO.pop(key))
