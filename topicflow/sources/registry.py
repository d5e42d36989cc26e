"""Run log and model registry as tables.

The reference keeps runs, parameters, metrics, artifacts and model versions in
a tracking server; here they are Parquet tables under one root (a shared
folder on a cluster). Rows are tiny (a run logs a few dozen values), written
by the driver as appends.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import existing_paths

RUNS_SCHEMA = "run_id string, experiment string, start_time double, artifacts array<string>"
PARAMS_SCHEMA = "run_id string, key string, value string"
METRICS_SCHEMA = "run_id string, key string, value double"
VERSIONS_SCHEMA = "model string, version int, uri string, run_id string"


def log_run(spark: SparkSession, root: str, experiment: str, params: Mapping[str, object] | None = None,
            metrics: Mapping[str, float] | None = None, artifacts: Sequence[str] = (),
            run_id: str | None = None, start_time: float | None = None) -> str:
    """Append one run with its parameters, metrics and artifact names."""
    rid = run_id or uuid.uuid4().hex
    t = float(start_time if start_time is not None else time.time())
    spark.createDataFrame([(rid, experiment, t, list(artifacts))], RUNS_SCHEMA) \
        .write.mode("append").parquet(f"{root}/runs")
    if params:
        spark.createDataFrame([(rid, k, None if v is None else str(v)) for k, v in params.items()], PARAMS_SCHEMA) \
            .write.mode("append").parquet(f"{root}/run_params")
    if metrics:
        spark.createDataFrame([(rid, k, float(v)) for k, v in metrics.items()], METRICS_SCHEMA) \
            .write.mode("append").parquet(f"{root}/run_metrics")
    return rid


def runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(f"{root}/runs")


def latest_run_with_artifact(runs_df: DataFrame, artifact: str) -> DataFrame:
    """The newest run that owns ``artifact`` (global latest; a
    TakeOrdered of one row, no global window)."""
    return (runs_df.where(F.array_contains("artifacts", artifact))
            .orderBy(F.desc("start_time"), F.asc("run_id")).limit(1))


def _claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; false if it exists. The file system lets one
    writer succeed (on a local one only the JDK's call is exclusive)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        return jvm.java.io.File(p.toUri().getPath()).createNewFile()
    try:
        fs.create(p, False).close()
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise


def register_version(spark: SparkSession, root: str, model: str, uri: str, run_id: str | None = None) -> int:
    """Append a new model version (next integer). The number is claimed by a
    file of its own before the row is written, and each row goes to a folder of
    its own, so writers that register at once get different numbers and don't
    meet; a writer that dies in between leaves a gap."""
    path = f"{root}/model_versions"
    cur = 0
    if existing_paths(spark, [path]):
        cur = spark.read.schema(VERSIONS_SCHEMA).parquet(path).where(F.col("model") == model) \
            .agg(F.max("version")).first()[0] or 0
    version = cur + 1
    while not _claim(spark, f"{root}/version_claims/{model}/{version}"):
        version += 1
    spark.createDataFrame([(model, version, uri, run_id)], VERSIONS_SCHEMA).write.parquet(f"{path}/entry={uuid.uuid4().hex}")
    return version


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version per model (``max_by``)."""
    return versions.groupBy("model").agg(F.max("version").alias("version"),
                                         F.max_by("uri", "version").alias("uri"))


def save_model(model: PipelineModel, path: str) -> None:
    """Save (overwrite) a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, local_path: str | None, root: str | None = None,
               model: str | None = None) -> PipelineModel | None:
    """Load from the local path first, then the registry's newest
    version; ``None`` when neither exists (the evaluation skips it). A path
    that exists but cannot be read is an error."""
    if local_path and existing_paths(spark, [local_path]):
        return PipelineModel.load(local_path)
    if root and model and existing_paths(spark, [f"{root}/model_versions"]):
        v = spark.read.schema(VERSIONS_SCHEMA).parquet(f"{root}/model_versions")
        row = latest_versions(v.where(F.col("model") == model)).first()
        if row is not None:
            return PipelineModel.load(row.uri)
    return None
