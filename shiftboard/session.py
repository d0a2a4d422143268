"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session should carry.  Time zone and ANSI mode decide results;
#: the rest let Spark re-plan joins and skewed partitions from run-time sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # files are cut into blocks by their size alone, not by the cores a session has at the moment
    "spark.sql.files.minPartitionNum": "200",
    # stored frames go when no frame refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "shiftboard", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none (local runs).
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shiftboard-"))
        current = sc.getCheckpointDir()
    return current


def hadoop(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path for it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; what is written there goes when the session's process ends."""
    path = posixpath.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    files, there = hadoop(spark, path)
    files.mkdirs(there.getParent())
    files.mkdirs(there)
    files.deleteOnExit(there)
    files.delete(there, True)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path whose rows nothing reads any more."""
    files, there = hadoop(spark, path)
    files.delete(there, True)


def pin(d: DataFrame) -> DataFrame:
    """Write ``d`` to the shared folder and cut its lineage.

    Used where rows carry a partition number or a row position: recomputing such
    rows could number them differently, so they are stored once, reliably.
    """
    shared_dir(d.sparkSession)
    return d.checkpoint(eager=True)
