"""Parallel scan of large CSV files whose quoted fields hold newlines.

Spark reads a multi-line CSV file in one task, as a task that starts in the
middle cannot know whether it stands inside quotes. Here the lines are read as
text, many splits per file, and the question is answered by counting:

1. Every split counts its quotes. Outside quotes an even number has gone by,
   inside an odd one (a doubled quote counts twice and changes nothing), so a
   prefix sum over the splits of a file tells each split how it starts.
2. Within a split, a line starts a record if an even number of quotes stands
   before it. Its lines are joined to records where they are; a record belongs
   to the split it starts in.
3. What a split begins with or leaves open is joined across splits, two pieces
   a split at most.
4. Whole records are parsed by ``from_csv`` with the fixed schema.

Texts are shuffled once, by split, which bounds every sort; the tables that
cross splits have a row or two per split. Only the order of lines within their
split is used, so a lost task gives the same rows again.

Files follow RFC 4180: quotes stand only around fields and doubled inside them;
a file whose quotes don't balance is an error. Lines end with ``\\n`` or
``\\r\\n``; every file begins with a header record; blank records are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..operators.common import broadcast_if_small, materialize

SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, line, value, quotes): block is the split's offset, line
    orders the lines of a split."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), "value",
                    (F.length("value") - F.length(F.translate("value", '"', ""))).cast("long").alias("quotes")))


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, open): whether a split starts and ends inside
    quotes. One row per split."""
    counts = materialize(lines.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes")), "csv-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    states = counts.select(*SPLIT, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"),
                           (F.sum("quotes").over(total) % 2).alias("open"))
    last = states.groupBy("file").agg(F.max_by("open", "block").alias("open")).where("open = 1").first()
    if last is not None:
        raise ValueError(f"quotes do not balance in {last['file']}")
    return states


def _pieces(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file, block, rec, body, last, open): the lines of each record within
    one split; rec 0 is what an earlier split began."""
    order = Window.partitionBy(*SPLIT).orderBy("line")
    marked = (lines.join(broadcast_if_small(states), SPLIT)
              .withColumn("before", F.col("inside") + F.sum("quotes").over(order) - F.col("quotes"))
              .withColumn("rec", F.sum((F.col("before") % 2 == 0).cast("long")).over(order)))
    joined = marked.groupBy(*SPLIT, "rec").agg(
        F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"), F.first("open").alias("open"))
    return (joined.select(*SPLIT, "rec", "open", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("body"))
            .withColumn("last", F.max("rec").over(Window.partitionBy(*SPLIT))))


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, rec, body): whole records with the split they start in;
    the header of a file is record 1 of its block 0."""
    lines = _lines(spark, path)
    pieces = _pieces(lines, split_states(lines))
    edge = (F.col("rec") == 0) | ((F.col("open") == 1) & (F.col("rec") == F.col("last")))
    whole = pieces.where(~edge).select(*SPLIT, "rec", "body")
    edges = materialize(pieces.where(edge).select(*SPLIT, "rec", "body"), "csv-edges")
    # each piece that starts a record owns the pieces without a start that follow it
    run = Window.partitionBy("file").orderBy("block", "rec").rowsBetween(Window.unboundedPreceding, 0)
    owner = edges.select(*SPLIT, "rec").withColumn(
        "own", F.max(F.when(F.col("rec") > 0, F.struct("block", "rec"))).over(run))
    glued = (edges.join(broadcast_if_small(owner), [*SPLIT, "rec"])
             .groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("block", "rec", "body"))).alias("parts"))
             .select("file", F.col("own.block").alias("block"), F.col("own.rec").alias("rec"),
                     F.array_join(F.transform("parts", lambda p: p["body"]), "\n").alias("body")))
    return whole.unionByName(glued)


def read_csv_split(spark: SparkSession, path: str | Sequence[str], schema: Ty.StructType) -> DataFrame:
    """The rows of CSV files with a header and quoted multi-line fields, read
    by as many tasks as the files have splits."""
    body = F.regexp_replace("body", "\r$", "")
    rows = (records(spark, path).where(~((F.col("block") == 0) & (F.col("rec") == 1)))
            .select(body.alias("body")).where(F.length(F.trim("body")) > 0))
    options = {"escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(F.from_csv("body", ddl, options).alias("r")).select("r.*")
