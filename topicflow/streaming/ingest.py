"""Structured Streaming jobs.

R01 incremental post ingest: JSON files -> text filter (P06) -> ids not seen
before (the reference kept seen ids only in one process) -> labels (P10) ->
serialized rows. Seen ids are keyed state in RocksDB, on the executors' disks
with its changes in the checkpoint: a batch looks up and writes its own ids
only, however many the earlier batches held, and reads neither its sink nor any
index. Of rows of one id within a batch the first by time stays. No watermark:
nothing is forgotten or dropped as late, whatever a post's age. Lines that are
not valid JSON go to a reject sink. Both sinks are written per batch id, so a
replayed batch overwrites its own output instead of duplicating it.

R02 continuous scoring: files of texts -> validation (P13) -> the *same*
cleaning Column as training -> ``PipelineModel.transform`` -> Parquet; invalid
rows go to a reject sink, a summary row per batch to a third (G17).
"""
from __future__ import annotations

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators import collect
from ..sources.readers import CORRUPT, RAW_POST_SCHEMA


def posts_stream(spark: SparkSession, source_glob: str, files_per_trigger: int = 1) -> DataFrame:
    """The raw posts; a line that is no JSON object is kept in ``CORRUPT``."""
    schema = Ty.StructType(RAW_POST_SCHEMA.fields + [Ty.StructField(CORRUPT, Ty.StringType())])
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("columnNameOfCorruptRecord", CORRUPT).json(source_glob))


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAD_LINE = "bad_line"                         # in payloads; a column of the reader's own name would be taken for a parse error
BAD = "!"                                     # keys of lines that are no JSON begin with it, those of posts with another sign


def keyed_posts(raw: DataFrame) -> DataFrame:
    """(key, created_utc, tie, payload) of posts with text and of bad lines; the
    payload holds the whole row."""
    rows = raw.where(F.col(CORRUPT).isNotNull() | T.has_text("title", "selftext"))
    tie = F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) for c in ("subreddit", "title", "selftext")])
    key = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit(BAD), F.sha2(CORRUPT, 256))).otherwise(
        F.concat(F.lit("#"), F.coalesce("id", F.lit(""))))
    return rows.select(key.alias("key"), "created_utc", tie.alias("tie"), F.to_json(F.struct(*[c for c in raw.columns if c != CORRUPT], F.col(CORRUPT).alias(BAD_LINE))).alias("payload"))


def first_seen(key, frames, state):
    """The first row of an id that has no state yet; every bad line."""
    best = None
    for f in frames:
        if key[0].startswith(BAD):
            yield f[["payload"]]
            continue
        if state.exists:                      # seen in an earlier batch: nothing to choose
            continue
        f = f if best is None else pd.concat([best, f])
        # most ids come once, and a sort of one row costs as much as the rest of the call
        best = f if len(f) == 1 else f.sort_values(["created_utc", "tie"], na_position="first", kind="stable").iloc[:1]
    if best is not None and not state.exists:
        state.update((True,))
        yield best[["payload"]]


def ingest_posts(spark: SparkSession, source_glob: str, sink: str, checkpoint: str,
                 inverted_map: DataFrame | None, label_mode: str = "hybrid",
                 include_title: bool = True, available_now: bool = True, files_per_trigger: int = 8,
                 rejects: str | None = None, state_store: str = ROCKS_DB):
    """Start (and with ``available_now`` drain) the ingest query.
    ``rejects`` (default: ``<sink>_rejects``) gets the lines that are not JSON."""
    bad_sink = rejects or f"{sink}_rejects"
    raw = posts_stream(spark, source_glob, files_per_trigger)
    new_rows = keyed_posts(raw).groupBy("key").applyInPandasWithState(
        first_seen, "payload string", "seen boolean", "append", "NoTimeout")
    schema = ", ".join(f"`{BAD_LINE if f.name == CORRUPT else f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    parsed = new_rows.select(F.from_json("payload", schema).alias("r")).select("r.*")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.where(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line")) \
                .write.mode("overwrite").parquet(f"{bad_sink}/batch={batch_id}")
            new = batch.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
            out = collect.serialize_posts(collect.assign_label(new, inverted_map, label_mode), include_title, True,
                                          keep=["label"])
            out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        finally:
            batch.unpersist()

    w = parsed.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, state_store)         # a query takes the setting when it starts
    try:
        q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.set(name, old)
    if available_now:
        q.awaitTermination()
    return q


TEXT_SCHEMA = Ty.StructType([Ty.StructField("doc_id", Ty.LongType()), Ty.StructField("text", Ty.StringType())])


def validate(df: DataFrame, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """The text must have at least one character and, where the caller
    sets a limit, at most ``max_chars``; adds ``reject_reason``."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    reason = F.when(n < 1, F.lit("empty"))
    if max_chars is not None:
        reason = reason.when(n > max_chars, F.lit("too_long"))
    return df.withColumn("reject_reason", reason)


def score_stream(spark: SparkSession, source_glob: str, model: PipelineModel, model_name: str,
                 clean_col, out_dir: str, reject_dir: str, checkpoint: str,
                 available_now: bool = True, max_chars: int | None = None):
    """Validation, training-time cleaning, scoring, two sinks."""
    from pyspark.ml.functions import vector_to_array
    src = spark.readStream.schema(TEXT_SCHEMA).json(source_glob)
    checked = validate(src, max_chars=max_chars)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        import time
        t0 = time.time()
        batch = batch.persist()
        bad = batch.where(F.col("reject_reason").isNotNull()).select("doc_id", "reject_reason")
        bad.write.mode("overwrite").parquet(f"{reject_dir}/batch={batch_id}")
        good = batch.where(F.col("reject_reason").isNull()).withColumn("text", clean_col)
        scored = model.transform(good)
        res = scored.select("doc_id", F.col("predicted_label").alias("predicted_topic"),
                            F.array_max(vector_to_array("probability")).alias("confidence"),
                            F.lit(model_name).alias("model_used"))
        res.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        # Batch summary (size, rejects, wall time) as a run metric table
        counts = batch.agg(F.count(F.lit(1)).alias("n_rows"),
                           F.count("reject_reason").alias("n_rejected")).first()
        spark.createDataFrame([(batch_id, counts.n_rows, counts.n_rejected, time.time() - t0)],
                              "batch_id long, n_rows long, n_rejected long, seconds double") \
            .write.mode("overwrite").parquet(f"{out_dir}_summary/batch={batch_id}")
        batch.unpersist()

    w = checked.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q
