"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "martflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are designed for.

    ``master`` is left to spark-submit unless given.  AQE coalesces small
    shuffles, splits skewed join partitions, and picks broadcast joins by
    measured size, so joins carry no unconditional hints.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Hash joins where every shuffled partition is measured to be this small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        # A commit writes its changes, not a copy of the state; a join keeps one store, not four.
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.join.stateFormatVersion": "3",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder for written tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary folder is
    used only in local mode; on a cluster a missing setting is an error,
    because a machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="martflow-")
    return _local_roots[app]


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a layer that several consumers read, and read it back.

    This is the batch counterpart of publishing to a topic: the layer is
    computed once, its lineage is cut, each consumer reads only the columns it
    needs, and a lost executor costs a re-read and not a recomputation.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def computed_once(batch: DataFrame, path: str) -> Iterator[DataFrame]:
    """A micro-batch for several readers, written to ``path`` while the block lasts.

    Frames that join a persisted micro-batch with itself do not all find it in the
    cache; each such reader runs the stateful plan in front of it again.
    """
    batch.write.mode("overwrite").parquet(path)
    try:
        yield batch.sparkSession.read.schema(batch.schema).parquet(path)
    finally:
        fs, folder = file_system(batch.sparkSession, path)
        fs.delete(folder, True)


def input_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    total = 0
    for path in paths:
        fs, folder = file_system(spark, path)
        total += fs.getContentSummary(folder).getLength()
    return total


@contextmanager
def state_partitions_for(spark: SparkSession, paths: Iterable[str], bytes_each: int = 16 << 20, slices: int = 1):
    """Start bounded streams with state partitions that fit their input.

    AQE does not coalesce the shuffles of stateful streams, so a small replay
    would pay for the session's full ``spark.sql.shuffle.partitions``.  The
    session's value stays the upper bound; without paths it is left alone.
    ``slices`` says in how many micro-batches the input comes.
    """
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    total = input_bytes(spark, paths) // slices
    wanted = max(spark.sparkContext.defaultParallelism, -(-total // bytes_each))
    with shuffle_partitions(spark, min(int(setting), wanted) if total else int(setting)):
        yield


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int):
    """So many shuffle partitions in the block; a stream started in it keeps them for its state."""
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
