"""Spark session defaults for local runs and tests.

On a cluster the session comes from the launcher; nothing here overrides
settings that are already present.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied only when the key is not already set on the session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 10,000 whole texts (the bound on rows) would stand in a task's JVM and its Python worker at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "sitelens", warehouse: str | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_defaults(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.appName(app)
               .master(master or f"local[{cpus}]")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus))))
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Only a local-mode session (tests,
    a laptop) without the setting gets a folder under the system temp
    directory; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    if sc is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            path = _local_fallback(spark.conf.get("spark.master", ""))
            spark.conf.set("spark.checkpoint.dir", path)
        return path
    current = sc.getCheckpointDir()
    if current is None:                        # once per session: every call of setCheckpointDir makes a folder
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or _local_fallback(sc.master))
        current = sc.getCheckpointDir()
    return current


def _local_fallback(master: str) -> str:
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/object store) "
                           "that every executor can reach")
    return tempfile.mkdtemp(prefix="sitelens-ckpt-")


def scale_conf(input_bytes: int, executor_cores: int = 4, executor_memory_gb: int = 16,
               executors: int = 1000) -> dict[str, str]:
    """Suggested SQL settings for a cluster run over ``input_bytes`` of Parquet.

    * scan splits of 256 MB (``files.maxPartitionBytes``);
    * shuffle partitions so the largest shuffle (≈ the input, before partial
      aggregation shrinks it) lands at ~200 MB per partition, at least two
      waves of the cluster's cores; AQE coalesces small ones at run time;
    * AQE skew handling for partitions over 4× the advisory size;
    * broadcast joins up to 64 MB per side, and only after Spark's size check
      (per-task memory is executor memory / cores, the hash table must fit).
    """
    cores = executor_cores * executors
    target = 200 * 1024 ** 2
    partitions = max(2 * cores, -(-input_bytes // target))
    per_task_mb = executor_memory_gb * 1024 // executor_cores
    broadcast_mb = max(10, min(64, per_task_mb // 16))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 ** 2),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_mb * 1024 ** 2),
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int, **kw) -> dict[str, str]:
    """Set the runtime SQL settings of :func:`scale_conf` on a session."""
    conf = scale_conf(input_bytes, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
