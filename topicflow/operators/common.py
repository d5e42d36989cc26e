"""Shared planning helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its rows and bytes were checked against these bounds.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Write a small side once, check its rows and bytes, and add a broadcast
    hint only when they prove it small. Beyond a bound the plan keeps a shuffle
    join. The side is a written table: nothing stays cached on the executors,
    and a lost one costs nothing.
    """
    from pyspark.sql import Observation
    rows = Observation()
    side = materialize(df.observe(rows, F.count(F.lit(1)).alias("n")), "side")       # counted while it is written
    if rows.get["n"] > max_rows or written_bytes(side) > max_bytes:
        return side
    return F.broadcast(side)


def written_bytes(table: DataFrame) -> int:
    """Size of a written table's files, as Spark's scan knows it."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a written table in the cluster's shared
    ``spark.checkpoint.dir`` (never a local checkpoint or a machine-local
    folder): computed once, columnar, and it survives executor loss.
    ``Dataset.checkpoint`` without a cache would compute the plan twice."""
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sum_bigint(c) -> F.Column:
    return F.sum(c).cast("bigint")
