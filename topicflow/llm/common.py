"""Helpers shared by the training-data operators.

Nothing here decides a result: scratch folders, byte-level access to the
shared folder from inside tasks, and connected components as DataFrame jobs.
"""
from __future__ import annotations

import contextlib
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import materialize  # noqa: F401  (re-exported to the operators)
from ..session import scratch_path, table_path

# ASCII white space used by every text operator here: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WORD_PATH = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def partitions(spark: SparkSession) -> int:
    """Reduce-side parallelism: the cluster's own setting, which its owner
    scales with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``, as a URI."""
    p = scratch_path(spark, name)
    return p if "://" in p else ("file://" + p if p.startswith("/") else p)


def open_fs(uri: str):
    """(filesystem, path) of a URI in the shared folder, usable in any task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def make_dirs(uri: str) -> None:
    f, p = open_fs(uri)
    f.create_dir(p, recursive=True)


def remove(uri: str) -> None:
    f, p = open_fs(uri)
    f.delete_file(p)


def fresh(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:16]}"


def tokenizer_path(name: str = WORD_PATH) -> str:
    """Place of a public vocabulary file; installed on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


def give_back() -> None:
    """Returns freed memory to the system."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):                  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A ``mapInArrow`` function that gives freed memory back when its task
    ends. Python workers are reused by later stages, which would otherwise
    inherit the largest heap any earlier task had."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def lean_group(run):
    """The same for the groups of ``applyInPandas``."""
    @functools.wraps(run)
    def group(pdf):
        try:
            return run(pdf)
        finally:
            give_back()
    return group


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside; for
    stages whose rows carry long texts or whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def deal(rows: DataFrame, label, code, sizes: dict, block: int, least: int) -> DataFrame:
    """Rows of two labels with a ``block`` each, dealt by the hash ``code``:
    about ``block`` rows of the commoner label in one, and at least about
    ``least`` of the rarer one (or all), whose rows are in several blocks then.
    ``copy`` numbers the blocks of a row. ``sizes``: rows of each label."""
    rare = min(sizes, key=lambda k: (sizes[k], k))
    blocks = max(1, -(-max(sizes.values()) // block))
    copies = min(blocks, max(1, -(-blocks * least // max(1, sizes[rare]))))
    own = F.explode(F.sequence(F.lit(0), F.when(label == rare, copies - 1).otherwise(0)))
    return (rows.withColumn("copy", own)
            .withColumn("block", F.pmod(F.pmod(code, F.lit(blocks)) + F.col("copy"), F.lit(blocks)).cast("int")))


def added(partial: DataFrame) -> np.ndarray:
    """Sums of the tasks' ``sums``, place by place."""
    rows = partial.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows)])


def binary_array(data, offsets) -> pa.Array:
    """Binary column from one buffer and int64 offsets (no copy per row)."""
    off = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id per linked id: ``(id, component_id)``.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and
    self-links don't matter; ids without a link are not returned; an empty
    frame gives an empty result; nulls are ignored. Alternating large-star
    and small-star rounds: each round is two aggregations (combined map-side)
    and two joins, and its result is written to the shared folder, so no
    lineage grows and a lost executor costs one round. The minima are written
    before the join, so both sides of it are plain exchanges that adaptive
    execution may split at a hub with very many links. The driver sees two
    numbers a round.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node points to the least of the node's neighbourhood
        sym = e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select(F.col("m"), F.col("v")))
        low = materialize(sym.groupBy("u").agg(F.min("w").alias("x")), "cc-min")
        e1 = materialize(sym.join(low, "u").where("w > u")
                         .select(F.col("w").alias("v"), F.least("u", "x").alias("m")).distinct(), "cc-large")
        # small star: a node and its smaller neighbours point to the least of them
        low = materialize(e1.groupBy("v").agg(F.min("m").alias("x")), "cc-min")
        e = materialize(e1.join(low, "v").where("m <> x").select(F.col("m").alias("v"), F.col("x").alias("m"))
                        .union(low.select("v", F.col("x").alias("m"))).distinct(), "cc-small")
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, m))")).first())
        if now == seen:
            return e.select(F.col("v").alias("id"), F.col("m").alias("component_id")).union(
                e.select(F.col("m"), F.col("m")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
