"""Inverted index for search listings.

A search listing otherwise reads title and body of every post. The index is a
set of written tables, extended by new posts only:

* ``posts``: a number per post and the columns a listing ranks by, no text;
* ``terms``: the distinct words with their bucket, a dictionary far smaller
  than the texts;
* ``postings``: partitioned by a bucket of the word; per word and block of
  numbers one row with the sorted numbers as differences. A block spans BLOCK
  numbers, so a word that every post holds is many short rows, never one
  group; the block number is the skip entry.

A query word matches as the plain listing matches, anywhere inside a word: the
dictionary tells the words that contain it, their buckets prune the scan. Words
of a query are intersected block by block: blocks that lack a word are skipped
before any differences are added up. A query of several words, or with marks,
is verified on the texts of its candidates alone, if texts are given.

Edge cases: null texts are empty; a query without a word character is an error;
repeated posts are posts each; an empty index finds nothing.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import existing_paths
from .collect import matches

BLOCK_BITS = 9                      # decoding adds up differences within a block, so blocks stay short
BUCKETS = 64
WORD = r"[\p{L}\p{N}_]+"
BATCH_BITS = 50                     # numbers of a batch start at batch << BATCH_BITS


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def batches_of(spark: SparkSession, folder: str) -> int:
    if not existing_paths(spark, [f"{folder}/posts"]):
        return 0
    return spark.read.parquet(f"{folder}/posts").agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]      # from folder names


def append(posts: DataFrame, folder: str, keep: list[str], buckets: int = BUCKETS) -> None:
    """Adds posts (``title``, ``selftext`` and the columns ``keep``) as a new
    batch. Earlier batches are not read."""
    spark = posts.sparkSession
    batch = batches_of(spark, folder)
    hay = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit("")))
    staged = f"{folder}/staged/batch={batch}"
    posts.select((F.monotonically_increasing_id() + (batch << BATCH_BITS)).alias("no"), *keep,
                 F.array_distinct(words_of(hay)).alias("words")).write.mode("overwrite").parquet(staged)
    numbered = spark.read.parquet(staged)           # numbers are fixed before anything refers to them
    one = numbered.select("no", F.explode("words").alias("term"))
    block = one.groupBy("term", F.shiftright("no", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("no")).alias("nos"))
    steps = F.transform("nos", lambda x, i: (x - F.when(i == 0, F.shiftleft("block", BLOCK_BITS)).otherwise(F.get("nos", i - 1))).cast("int"))
    rows = block.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "block", F.size("nos").alias("n"), steps.alias("steps"))
    rows.repartition("bucket", "term").sortWithinPartitions("bucket", "term", "block") \
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/batch={batch}")
    spark.read.parquet(f"{folder}/postings/batch={batch}").select("bucket", "term").distinct() \
        .write.mode("overwrite").parquet(f"{folder}/terms/batch={batch}")
    numbered.drop("words").write.mode("overwrite").parquet(f"{folder}/posts/batch={batch}")          # last: the batch counts


def matching_terms(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(word, term, bucket): dictionary words that contain a query word."""
    wanted = sorted(set(re.findall(r"\w+", query.lower())))
    if not wanted:
        raise ValueError("a search needs a word")
    terms = spark.read.parquet(f"{folder}/terms").select("term", "bucket").distinct()
    hit = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.instr(F.col("term"), w) > 0)
    return terms.select(F.explode(hit).alias("word"), "term", "bucket")


def find(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(no) of the posts that hold every word of the query."""
    terms = matching_terms(spark, folder, query)
    n_words = len(set(re.findall(r"\w+", query.lower())))
    buckets = [r[0] for r in terms.select("bucket").distinct().collect()]           # at most BUCKETS numbers
    rows = (spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
            .join(terms, ["bucket", "term"]))
    by_word = rows.groupBy("block", "word").agg(F.collect_list("steps").alias("lists"))
    full = by_word.groupBy("block").agg(F.collect_list("lists").alias("all")).where(F.size("all") == n_words)      # skips the other blocks

    def numbers(lists):
        """The numbers (within the block) of any of a word's lists."""
        return F.array_distinct(F.flatten(F.transform(lists, lambda s: F.transform(s, lambda x, i: F.aggregate(
            F.slice(s, 1, i + 1), F.lit(0), lambda a, d: a + d)))))
    common = F.aggregate(F.slice("all", 2, 1 << 30), numbers(F.get("all", F.lit(0))), lambda a, lists: F.array_intersect(a, numbers(lists)))
    return full.select("block", F.explode(common).alias("at")).select((F.shiftleft("block", BLOCK_BITS) + F.col("at")).alias("no"))


def search(spark: SparkSession, folder: str, query: str, texts: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """The kept columns of matching posts. A query that is more than one bare
    word is verified by the listing's own match on ``texts`` (columns ``on``,
    ``title``, ``selftext``), read for the candidates only."""
    found = spark.read.parquet(f"{folder}/posts").join(find(spark, folder, query), "no").drop("no", "batch")
    if re.fullmatch(r"\w+", query.lower()):
        return found
    if texts is None:
        raise ValueError("a query of several words is verified on the texts")
    return found.join(texts.select(*on, "title", "selftext"), on).where(matches(query)).drop("title", "selftext")
