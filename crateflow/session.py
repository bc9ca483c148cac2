"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces small
# partitions at runtime; skew join splits hot partitions of sort-merge joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "crateflow", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the session comes from the launcher."""
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CRATEFLOW_DRIVER_MEM", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Where it is
    unset, a session in one JVM (``local``) gets a scratch folder of its own,
    registered so that later calls agree on it; on a cluster this is an
    error, as each executor would write to its own disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="crateflow-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Survives executor loss (the data is on shared storage) and, unlike an
    RDD checkpoint, restarts size statistics from the written files: in a
    loop, the estimate of a checkpointed join would otherwise keep the
    product of all earlier estimates and planning time would explode. A loop
    calls ``drop_scratch`` on the table of a round that is over.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ckpt")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(df) -> None:
    """Delete the table behind a frame that ``cut_lineage`` returned; any other frame is left alone."""
    path = getattr(df, "scratch", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
