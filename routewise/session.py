"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "routewise") -> SparkSession:
    """Return a session configured for the engine.

    An existing session is used as it is; the local defaults below apply only
    when there is none yet (tests, bench).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}   # application id -> scratch folder of a local session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, or a scratch folder of a local session.

    The session's configuration is never changed.  Without the setting, a session on ``local[...]`` gets
    one scratch folder, removed when the process ends; any other master raises, because its executors
    would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
    if sc.applicationId not in _LOCAL:
        path = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="routewise-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _LOCAL[sc.applicationId]


def written_root(spark: SparkSession) -> str:
    """Where this application's written tables lie."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/routewise-{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> bool:
    """Delete this application's written tables, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
