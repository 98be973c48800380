"""Session construction and shared-storage helpers.

The library never assumes a machine-local scratch folder on a cluster: any
state that must survive executor loss (checkpoints, streaming inputs and
sinks) goes under ``spark.checkpoint.dir``, which the cluster names.  Only
when that setting is absent *and* the master is local (tests, laptop runs)
do we create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults tuned for scale: AQE re-plans joins from runtime sizes, coalesces
# small shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE coalesce / split partitions of plans that are being cached too
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "penalytics", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="penalytics-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never reused), as Spark names it:
    its scheme stays, so it means the same folder whatever the default file system is."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder of the shared store through Spark's file-system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cluster_conf(total_cores: int, executor_memory_gb: int = 16) -> dict:
    """Starting settings for a large cluster (pass as ``extra`` or spark-submit --conf).

    * Shuffle partitions ~3 per core: AQE coalesces small ones and splits
      skewed ones at runtime, so over-provisioning is cheap and a hot key
      never lands in an oversized task.
    * 128 MB file splits and 128 MB advisory post-shuffle partitions keep a
      task's working set far below an executor's memory share.
    * Broadcasts stay at Spark's size check (10 MB by plan statistics); AQE
      re-checks with runtime sizes before converting a join.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(8, 3 * total_cores)),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
        "spark.executor.memory": f"{executor_memory_gb}g",
    }
