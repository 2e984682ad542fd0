"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are far below the size at which merging partitions pays.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python line of every column costs most of the time it
        # takes to build a plan.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables.

    It lies under ``spark.checkpoint.dir``, which a cluster points at storage
    that all executors share.  Only where the session names none and runs on
    one machine a local temporary folder is used, and set for checkpoints too;
    on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trailframe-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/trailframe/{purpose}-{uuid.uuid4().hex}"


_LANDED: dict[tuple, str] = {}


def land_once(spark: SparkSession, name: tuple[str, ...], build, source: str | None = None):
    """A derived table that is written at its first use in a session.

    Later uses read the stored files, so that each prunes the columns it needs
    and none derives the table again.  If the files of ``source`` have changed
    since, the table is derived anew.
    """
    key = (spark.sparkContext.applicationId, *name, source and file_state(spark, source))
    path = _LANDED.get(key)
    if path is None or not path_exists(spark, path):
        path = _LANDED[key] = shared_folder(spark, name[0])
        build().write.parquet(path)
        remove_at_exit(spark, path)
    return spark.read.parquet(path)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def file_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and latest change of a file or folder."""
    target, system = _hadoop(spark, path)
    summary = system.getContentSummary(target)
    return summary.getLength(), summary.getFileCount(), system.getFileStatus(target).getModificationTime()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate files go when the application ends."""
    target, system = _hadoop(spark, path)
    system.deleteOnExit(target)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether some file or folder matches ``pattern``."""
    target, system = _hadoop(spark, pattern)
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def write_through(df, purpose: str):
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of results that several branches of a plan use, or that a
    loop builds on; the files survive the loss of executors.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
