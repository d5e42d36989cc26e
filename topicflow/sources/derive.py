"""Inputs derived from the driver tables (FIXTURES.md §2).

The reference's own corpus is not shipped; these derivations give both Spark
and the SQL oracle the same rows, and they grow with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Language order used by the derived taxonomy and predictor.
LANG_ORDER = ("en", "de", "es", "fr")
NEXT_LANG = {"en": "de", "de": "es", "es": "fr", "fr": "en"}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, text, domain = lang, raw_target = source)."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("domain"), F.col("source").alias("raw_target"))


def _src_number(c) -> F.Column:
    return F.regexp_extract(c, r"^src(\d+)$", 1).cast("int")


def derived_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, srcN) -> ``topic_`` + two digits of (N + 5 i) % 20 with
    i = position of lang in en, de, es, fr; (es, src19) left unmapped."""
    pairs = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("domain"), F.col("source").alias("raw_target")).distinct()
    i = F.array_position(F.array(*[F.lit(x) for x in LANG_ORDER]), F.col("domain")) - 1
    n = _src_number(F.col("raw_target"))
    topic = F.concat(F.lit("topic_"), F.lpad(((n + i * 5) % 20).cast("string"), 2, "0"))
    return (pairs.where((i >= 0) & n.isNotNull()
                        & ~((F.col("domain") == "es") & (F.col("raw_target") == "src19")))
            .select("domain", "raw_target", topic.alias("topic")))


def derived_topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"topic_{k:02d}",) for k in range(20)], "topic string")


def predictions(spark: SparkSession, sf_dir: str, salt: str = "p",
                model: str = "fixed_predictor") -> DataFrame:
    """Deterministic predictions table ``(model, doc_id, domain, y, p)``:
    h = md5(salt ':' doc_id); 'xx' if h starts with 'ff'; the true language
    if the first hex digit <= 'b'; otherwise the next language."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("y"))
    h = F.md5(F.concat(F.lit(f"{salt}:"), F.col("doc_id").cast("string")))
    nxt = F.create_map(*[F.lit(x) for kv in NEXT_LANG.items() for x in kv])
    p = (F.when(F.substring(h, 1, 2) == "ff", F.lit("xx"))
         .when(F.substring(h, 1, 1) <= "b", F.col("y"))
         .otherwise(F.try_element_at(nxt, F.col("y"))))
    return d.select(F.lit(model).alias("model"), "doc_id", F.col("y").alias("domain"),
                    "y", p.alias("p"))


def posts(spark: SparkSession, sf_dir: str, with_copies: bool = True) -> DataFrame:
    """Raw posts from documents: id, title (first line), selftext (rest),
    subreddit = source, flair ' Flagged ' for toxic rows, created_utc =
    1700000000 + 60 doc_id, score = n_chars % 1000, and more metadata.
    Copies of doc_id % 10 = 0 are appended (same id) to exercise dedup."""
    d = read_table(spark, sf_dir, "documents").alias("d")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    # labels has at most one row per document; it is joined on the key
    j = d.join(lab, "doc_id", "left")
    title = F.substring_index(F.col("text"), "\n", 1)
    body = F.when(F.instr(F.col("text"), "\n") > 0,
                  F.substring(F.col("text"), F.instr(F.col("text"), "\n") + 1, 1 << 30)).otherwise(F.lit(""))
    base = j.select(
        F.col("doc_id").cast("string").alias("id"),
        title.alias("title"),
        body.alias("selftext"),
        F.col("source").alias("subreddit"),
        F.when(F.col("toxic") == 1, F.lit(" Flagged ")).alias("link_flair_text"),
        (F.lit(1700000000) + F.col("doc_id") * 60).cast("double").alias("created_utc"),
        F.concat(F.lit("/r/"), F.col("source"), F.lit("/comments/"), F.col("doc_id").cast("string"), F.lit("/")).alias("permalink"),
        (F.length(body) > 0).alias("is_self"),
        (F.col("toxic") == 1).alias("over_18"),
        (F.col("n_chars") % 97).cast("int").alias("num_comments"),
        (F.col("n_chars") % 1000).cast("int").alias("score"),
        F.when(F.col("quality").isNotNull(), F.lit(0.5) + F.col("quality") * 0.4).alias("upvote_ratio"),
        F.lit(0).alias("copy"),
    )
    if not with_copies:
        return base
    copies = base.where(F.col("id").cast("bigint") % 10 == 0).withColumn("copy", F.lit(1))
    return base.unionByName(copies)


def topic_map(spark: SparkSession, sf_dir: str, n_topics: int = 7) -> DataFrame:
    """(topic, position, subreddits) like the YAML map: ``src(k)`` -> ``T(k % 7)``,
    ``src19`` left out. Subreddit lists are sorted by k."""
    srcs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("s")).distinct()
    k = _src_number(F.col("s"))
    return (srcs.where(k.isNotNull() & (F.col("s") != "src19"))
            .select(F.concat(F.lit("T"), (k % n_topics).cast("string")).alias("topic"),
                    (k % n_topics).cast("int").alias("position"), k.alias("k"), "s")
            .groupBy("topic", "position")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("subreddits")))
