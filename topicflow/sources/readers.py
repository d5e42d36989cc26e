"""Scans and sinks.

Fixed schemas everywhere; no schema inference. Texts hold newlines, so Spark's
own CSV scan needs ``multiLine`` and one task per file (:func:`read_csv`);
:mod:`.split_csv` reads the same files by split, and the registered source
"csv" uses it.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .split_csv import read_csv_split

CORPUS_SCHEMA = Ty.StructType([
    Ty.StructField("doc_id", Ty.LongType()),
    Ty.StructField("text", Ty.StringType()),
    Ty.StructField("target", Ty.StringType()),
])

RAW_POST_SCHEMA = Ty.StructType([
    Ty.StructField("id", Ty.StringType()),
    Ty.StructField("title", Ty.StringType()),
    Ty.StructField("selftext", Ty.StringType()),
    Ty.StructField("subreddit", Ty.StringType()),
    Ty.StructField("link_flair_text", Ty.StringType()),
    Ty.StructField("created_utc", Ty.DoubleType()),
    Ty.StructField("permalink", Ty.StringType()),
    Ty.StructField("is_self", Ty.BooleanType()),
    Ty.StructField("over_18", Ty.BooleanType()),
    Ty.StructField("num_comments", Ty.IntegerType()),
    Ty.StructField("score", Ty.IntegerType()),
    Ty.StructField("upvote_ratio", Ty.DoubleType()),
])

SOCIAL_SCHEMA = Ty.StructType([
    Ty.StructField("text", Ty.StringType()),
    Ty.StructField("label", Ty.StringType()),
])

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: Ty.StructType = CORPUS_SCHEMA) -> DataFrame:
    """CSV with header, quoted multi-line fields."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "FAILFAST").csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, no index column."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: Ty.StructType,
               keep_corrupt: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; a bad line lands in
    ``_corrupt_record`` (PERMISSIVE) instead of failing the job."""
    s = schema
    if keep_corrupt and CORRUPT not in schema.fieldNames():
        s = Ty.StructType(schema.fields + [Ty.StructField(CORRUPT, Ty.StringType())])
    r = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return r.json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, UTF-8 (Spark never ASCII-escapes), appended."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def good_lines(raw: DataFrame, rejects: str | None = None) -> DataFrame:
    """The parsed lines of a :func:`read_jsonl` frame. Bad lines are never
    dropped unseen: they are written to ``rejects`` where the caller names a
    folder, otherwise the first action on any of them fails the job."""
    if rejects is not None:
        kept = raw.cache()        # Spark refuses a query on raw JSON that reads the corrupt column alone
        try:
            kept.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line")) \
                .write.mode("overwrite").parquet(rejects)
        finally:
            kept.unpersist()
        return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    fine = F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON line: "), F.substring(CORRUPT, 1, 200))).cast("boolean"))
    return raw.where(fine).drop(CORRUPT)


def social_posts(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """S02 for the social loader: keep ``text`` and ``label`` -> ``target``."""
    d = good_lines(read_jsonl(spark, path, SOCIAL_SCHEMA), rejects)
    return d.select("text", F.col("label").alias("target"))


def class_names(df: DataFrame, id_col: str, names: Sequence[str], out: str = "target") -> DataFrame:
    """Class index -> name through a literal array (1-based lookup);
    an unknown index gives null."""
    arr = F.array(*[F.lit(n) for n in names])
    return df.withColumn(out, F.try_element_at(arr, F.col(id_col).cast("int") + 1))


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Union-all of train/test shards by column name."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """S06 helper: the given paths that exist (Hadoop FileSystem API)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            out.append(p)
    return out


def read_optional(spark: SparkSession, files: dict[str, str],
                  reader: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Read the files that exist, add their domain, union; error only
    when none exists."""
    present = existing_paths(spark, list(files.values()))
    if not present:
        raise RuntimeError("No domain input files found.")
    dfs = [reader(spark, p).withColumn("domain", F.lit(d)) for d, p in files.items() if p in present]
    return union_shards(dfs)


# Source registry name -> loader(spark, path) -> (doc_id?, text, target).
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda spark, path: read_csv_split(spark, path, CORPUS_SCHEMA),
    "social_jsonl": social_posts,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def load_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Unknown source names raise ``ValueError``; each source keeps its
    own name in ``source`` (the reference overwrote one output file)."""
    if name not in SOURCES:
        raise ValueError(f"Unknown dataset: {name}")
    return SOURCES[name](spark, path).withColumn("source", F.lit(name))
