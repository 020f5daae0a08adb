"""Session helpers.

The library never creates a session behind the caller's back: every
operator takes the session (or a DataFrame) it is given.  ``local_session``
exists for tests, ``bench.py`` and notebooks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "hearth") -> SparkSession:
    """A local session tuned like a small cluster: AQE on, UI off."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HEARTH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system all
    executors and the driver see).  Only when it is unset and the master is
    local -- tests and notebooks -- do we create one of our own and register
    it, so that ``DataFrame.checkpoint()`` and written intermediate tables
    land in the same place; it is removed when the driver ends.  On a cluster
    an unset folder is an error: a folder of one machine would lose data.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir() or conf_dir
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="hearth-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for an intermediate table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/hearth-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a narrow frame that several passes read: the plan that makes it runs
    once, filters on its columns are pushed into the scan, and the rows
    survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``stage``, and aggregates of the rows that the same write collects on its
    way: no second scan and no second job for figures that the rows pass by."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    staged = stage(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return staged, dict(seen.get)


def drop_stages(spark: SparkSession) -> None:
    """Remove every intermediate table of this library from the shared folder
    (for the end of a job, when no result needs them any more)."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(base):
        if status.getPath().getName().startswith("hearth-"):
            fs.delete(status.getPath(), True)
