"""Session helpers.

On a cluster the session is created by the platform; we only read settings
from it. Local defaults (tests, bench) are applied only where unset.
"""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "topicflow", **conf) -> SparkSession:
    """A local-mode session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_DEFAULTS, "spark.driver.memory": "16g", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    (local tests) is a private scratch folder created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        master = spark.sparkContext.master if hasattr(spark, "sparkContext") else ""
        if str(master).split("[")[0] != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder: lineage cuts and stream "
                               "checkpoints must survive executor loss.")
        d = tempfile.mkdtemp(prefix="topicflow-ckpt-")     # local mode only (tests, bench)
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Tables whose rows carry long texts (heavy per-row cleaning), with their key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def spread(df, key: str | None = None, min_partitions: int | None = None):
    """Spread the rows over the cluster's parallelism only when the scan
    yields fewer partitions than that (e.g. a file with one row group). With
    a key the rows are hash-partitioned on it (deterministic on retry without
    the local sort a round-robin repartition needs). On a large input the scan
    already has many splits and nothing is added."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # Spark Connect: no RDD API; leave the plan as it is
        return df
    if n >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df
