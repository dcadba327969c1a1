"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at fleet scale; local runs override the partition count.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what is measured to be small: no static (estimate-based)
    # broadcast; AQE converts a join to a broadcast when the materialised side
    # is under the threshold. Explicit hints are used only on static dimensions.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
WIDE_ROWS = 8 << 20     # bytes of a row group whose rows are documents


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "fleetgrade") -> SparkSession:
    """Return the active session, or build one for local runs and tests."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cores}]")
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or int(cores)))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Identifier of the Spark application (works for classic and Connect sessions)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a local one only if unset.

    On a cluster the setting names a shared folder that survives executor loss.
    A private temporary folder is chosen only when nothing is configured and the
    master is local, which is the case in tests and benches; a cluster without the
    setting raises, since each executor would write to its own disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="fleetgrade-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame, name: str = "table", partition_by: list[str] | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Unlike ``checkpoint(eager=True)``, which runs the plan once to count and again
    to write, this computes the plan a single time. The folder is the cluster's
    ``spark.checkpoint.dir``, so the table survives executor loss. ``wide``: its rows
    hold whole documents; a task reads some thousand rows of a row group at once, so
    row groups are small.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/fleetgrade/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if wide:
        writer = writer.option("parquet.block.size", WIDE_ROWS)
    writer.parquet(path)
    # The schema is given, since an empty partitioned table has no file to read it from.
    return spark.read.schema(df.schema).parquet(path)
