"""Session set-up and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STREAMING = "spark.sql.streaming"
# a commit writes what changed, not all files; a write does not look first whether the row is new; a join's four tables
# share one store
STATE = {
    f"{_STREAMING}.stateStore.providerClass": STATE_STORE,
    f"{_STREAMING}.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STREAMING}.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STREAMING}.join.stateFormatVersion": "3",
}


def get_spark(app_name: str = "gatelens", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A UTC session with AQE on. Cluster sizes (partitions, memory) are left to the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in STATE.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_state_store(spark: SparkSession) -> None:
    """The state store of all streaming queries that this session starts from now on."""
    for key, value in STATE.items():
        spark.conf.set(key, value)


def sizing(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about this many bytes: initial partitions of some 128 MB, at least three per
    core. AQE joins small ones at run time and splits skewed ones in joins; it cannot split too large ones elsewhere.
    """
    target = 128 << 20
    partitions = max(3 * cores, -(-shuffled_bytes // target))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.files.maxPartitionBytes": str(2 * target),
    }


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    Only where neither the session nor its context names one and all runs on one machine (tests) a temporary folder is
    made and set; on a cluster executors would each write to their own disk, so this is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gatelens-"))
        base = spark.sparkContext.getCheckpointDir()
    return os.path.join(base, f"{tag}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table that several steps read to the shared scratch folder, and read it back.

    Cuts the lineage: later steps never compute it again, also when executors are lost, and its size is known to the
    planner.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path (or glob) matches something on its own file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()
