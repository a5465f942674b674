"""Session construction and shared-folder settings.

On a cluster the session is built by the platform; ``get_spark`` only fills in
settings that are unset, so cluster-level values (shuffle partitions,
checkpoint folder, AQE) always win.
"""

from __future__ import annotations

import gc
import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings applied only when the session does not carry them already.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # Concurrent streams share the executors by pool instead of first come, first served.
    "spark.scheduler.mode": "FAIR",
    "spark.scheduler.allocation.file": Path(__file__).with_name("pools.xml").as_uri(),
    # Keyed streaming state on local disk with change logs in the checkpoint, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the frame that wrote them is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Partition sizing: AQE merges small shuffle partitions up to the advisory
    # size and splits skewed ones; scans cut files into 256 MB splits.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "fillwise") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("FILLWISE_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    It is registered once per context (each registration adds a folder level).
    Only a local session that names none (tests, benches) gets a fresh scratch
    folder; on a cluster executors would not see it, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fillwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Free the shuffle files of finished jobs now.

    They stay on the executors' disks until the driver, whose heap fills slowly, collects the plans that made them; so
    a step that shuffled a whole table leaves them there while the next one shuffles it again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
