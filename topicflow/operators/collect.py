"""Quota-based post collection over a posts table (S12, S13, P06-P10, W05,
W06, T02, X22, J02).

The reference pulls listings from a live site post by post with early exits.
Here the posts already sit in a table, and every step is a DataFrame job:

  listing (per-subreddit top-k, ``row_number() <= limit``; Spark plans a
  partial ``WindowGroupLimit`` before the shuffle, so a hot subreddit sends at
  most ``limit`` rows per task) -> text filter (P06) -> first-seen dedup (W05,
  an aggregation with map-side partial ``min_by``) -> per-topic quota rank ->
  strict total cap through prefix sums over the small per-topic count table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import broadcast_if_small, materialize

# Listing time filters in seconds; "all" means no filter.
TIME_FILTERS = {"all": None, "year": 365 * 86400, "month": 30 * 86400, "week": 7 * 86400,
                "day": 86400, "hour": 3600}
MODES = ("new", "hot", "top", "search")
# The publicly documented "hot" ranking: sign(s)*log10(max(|s|,1))
# + (created - 1134028003) / 45000.
HOT_EPOCH, HOT_SCALE = 1134028003, 45000.0


def invert_topic_map(topic_map: DataFrame) -> DataFrame:
    """(topic, position, subreddits) -> (sub_key = lower(sub), bucket);
    a subreddit listed under several topics keeps the last one."""
    e = topic_map.select("topic", "position", F.posexplode_outer("subreddits").alias("sub_pos", "sub"))
    e = e.where(F.col("sub").isNotNull())
    return (e.groupBy(F.lower(F.col("sub").cast("string")).alias("sub_key"))
            .agg(F.max_by("topic", F.struct("position", "sub_pos")).alias("bucket")))


def topic_subs(topic_map: DataFrame, seed: int = 42) -> DataFrame:
    """(topic, topic_pos, subreddit, sub_pos): subreddits of each topic in a
    seeded order (T02; the reference shuffles them without a seed)."""
    e = topic_map.select("topic", F.col("position").alias("topic_pos"),
                         F.explode_outer("subreddits").alias("subreddit")).where(F.col("subreddit").isNotNull())
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("topic"), F.col("subreddit")))
    w = Window.partitionBy("topic").orderBy(key, "subreddit")
    return e.withColumn("sub_pos", F.row_number().over(w))


def serialized_columns(include_title: bool = True, full: bool = True) -> list[Column]:
    """P08 + P09 + X22: text and (when ``full``) the metadata with casts and
    defaults: bool false, int 0, nullable ratio, permalink with site host."""
    cols = [T.post_text("title", "selftext", include_title).alias("text")]
    if full:
        cols += [
            F.col("id").cast("string").alias("id"),
            F.col("subreddit").cast("string").alias("subreddit"),
            F.col("link_flair_text").alias("flair"),
            T.iso_utc("created_utc").alias("created_utc"),
            F.concat(F.lit(T.PERMALINK_HOST), F.col("permalink")).alias("permalink"),
            F.coalesce(F.col("is_self").cast("boolean"), F.lit(False)).alias("is_self"),
            F.coalesce(F.col("over_18").cast("boolean"), F.lit(False)).alias("over_18"),
            F.coalesce(F.col("num_comments").cast("int"), F.lit(0)).alias("num_comments"),
            F.coalesce(F.col("score").cast("int"), F.lit(0)).alias("score"),
            F.col("upvote_ratio").cast("double").alias("upvote_ratio"),
        ]
    return cols


def serialize_posts(raw: DataFrame, include_title: bool = True, full: bool = True,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Serialized posts, optionally keeping extra columns (e.g. ``label``)."""
    return raw.select(*keep, *serialized_columns(include_title, full))


def assign_label(posts: DataFrame, inverted: DataFrame | None, mode: str = "hybrid",
                 sub_col: str = "subreddit", flair_col: str = "link_flair_text") -> DataFrame:
    """P10 + J02: bucket via a broadcast left join on ``lower(subreddit)``."""
    if inverted is None:
        return posts.withColumn("label", T.label_rule(sub_col, flair_col, F.lit(None).cast("string"), mode))
    inv = broadcast_if_small(inverted.withColumnRenamed("sub_key", "_sub_key"), 1_000_000)
    j = posts.withColumn("_sub_key", F.lower(F.col(sub_col))).join(inv, "_sub_key", "left")
    return j.withColumn("label", T.label_rule(sub_col, flair_col, "bucket", mode)).drop("_sub_key", "bucket")


def _hot(score: Column, created: Column) -> Column:
    s = score.cast("double")
    order = F.log10(F.greatest(F.abs(s), F.lit(1.0)))
    return F.signum(s) * order + (created - HOT_EPOCH) / HOT_SCALE


def matches(query: str) -> Column:
    """Case-insensitive match of a query in title and body."""
    hay = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))))
    return F.instr(hay, query.lower()) > 0


def list_posts(posts: DataFrame, mode: str = "top", limit: int = 1000, time_filter: str = "year",
               query: str | None = None, as_of: float | None = None, match: Column | None = None,
               sub_col: str = "subreddit", tie_break: Sequence[str] = ("copy",)) -> DataFrame:
    """Per-subreddit listing with ``listing_rank`` 1..limit.

    new = newest first; hot = public hot score; top = time filter, then
    score; search = case-insensitive text match + time filter, newest first.
    Time filters are relative to ``as_of`` (epoch seconds). ``match`` replaces
    the text match by a column computed before, so the listing can rank narrow
    rows without their texts."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, not {mode!r}")
    if mode == "search" and not query:
        raise ValueError("a search listing needs a query string")
    if time_filter not in TIME_FILTERS:
        raise ValueError(f"time_filter must be one of {sorted(TIME_FILTERS)}, not {time_filter!r}")
    df = posts
    span = TIME_FILTERS[time_filter]
    if mode in ("top", "search") and span is not None:
        if as_of is None:
            raise ValueError("time filters need as_of")
        df = df.where(F.col("created_utc") > F.lit(float(as_of - span)))
    if mode == "search":
        df = df.where(matches(query) if match is None else match)
    # ties: post id, then any extra tie-break columns the table carries
    ties = [F.asc(c) for c in ("id", *tie_break) if c in df.columns]
    order = {
        "new": [F.desc("created_utc")],
        "search": [F.desc("created_utc")],
        "top": [F.desc("score"), F.desc("created_utc")],
        "hot": [F.desc(_hot(F.col("score"), F.col("created_utc")))],
    }[mode] + ties
    w = Window.partitionBy(sub_col).orderBy(*order)
    return df.withColumn("listing_rank", F.row_number().over(w)).where(F.col("listing_rank") <= limit)


def dedup_first_seen(df: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Keep the first occurrence of each id by ``order``. An
    aggregation (partial ``min_by`` per task) rather than a window, so many
    copies of one id never gather in one task before being reduced."""
    payload = [c for c in df.columns if c != id_col]
    agg = df.groupBy(id_col).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_first"))
    return agg.select(id_col, *[F.col(f"_first.{c}").alias(c) for c in payload])


def _cap_by_prefix(df: DataFrame, group: str, group_pos: str, rank: str, quota: int,
                   total: int) -> DataFrame:
    """Keep rows with ``rank <= quota`` and the first ``total`` rows over the
    order (group_pos, rank), using prefix sums over the small per-group
    count table instead of a global window."""
    # at most quota rows per group (bounded by the quota parameters); read twice
    # below, so kept once instead of re-running listing, dedup and ranking
    kept = materialize(df.where(F.col(rank) <= quota), "quota")
    counts = kept.groupBy(group, group_pos).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(group_pos, group).rowsBetween(Window.unboundedPreceding, -1)
    budget = counts.select(group, F.greatest(F.lit(0), F.lit(total) - F.coalesce(F.sum("_n").over(w), F.lit(0)))
                           .alias("_budget"))
    budget = broadcast_if_small(budget, 1_000_000)
    return kept.join(budget, group).where(F.col(rank) <= F.col("_budget")).drop("_budget")


def collect_by_topic(posts: DataFrame, topic_map: DataFrame, target_count: int = 15000,
                     per_subreddit_limit: int = 2000, per_topic_limit: int | None = None,
                     mode: str = "top", time_filter: str = "year", query: str | None = None,
                     as_of: float | None = None, label_mode: str = "hybrid",
                     include_title: bool = True, full: bool = True, seed: int = 42) -> DataFrame:
    """W06, topic mode: per-topic cap = ``per_topic_limit`` or
    ``max(1, target // topics)``; per-subreddit pull limit; strict total cap
    (the reference may overshoot between topics; we do not)."""
    subs = topic_subs(topic_map, seed)
    n_topics = max(1, topic_map.count())
    per_topic = per_topic_limit or max(1, target_count // n_topics)
    subs_b = broadcast_if_small(subs.withColumn("_sub_key", F.lower("subreddit")).drop("subreddit"), 1_000_000)
    p = posts.withColumn("_sub_key", F.lower("subreddit")).join(subs_b, "_sub_key").drop("_sub_key")
    listed = list_posts(p, mode, per_subreddit_limit, time_filter, query, as_of)
    listed = listed.where(T.has_text("title", "selftext"))
    first = dedup_first_seen(listed, ["topic_pos", "sub_pos", "listing_rank"])
    wt = Window.partitionBy("topic").orderBy("sub_pos", "listing_rank")
    ranked = first.withColumn("topic_rank", F.row_number().over(wt))
    kept = _cap_by_prefix(ranked, "topic", "topic_pos", "topic_rank", per_topic, target_count)
    labeled = assign_label(kept, invert_topic_map(topic_map), label_mode)
    return serialize_posts(labeled, include_title, full, keep=["topic", "topic_rank", "label"])


def collect_by_subreddit(posts: DataFrame, subreddits: Sequence[str] | DataFrame, target_count: int = 15000,
                         per_subreddit_limit: int = 2000, mode: str = "top", time_filter: str = "year",
                         query: str | None = None, as_of: float | None = None, label_mode: str = "hybrid",
                         include_title: bool = True, full: bool = True) -> DataFrame:
    """W06, subreddit mode: subreddits in the given order, per-subreddit
    target ``max(1, target // subs)``, total capped at ``target``; labels
    without a topic map (flair else subreddit). The subreddits are a list, or a
    DataFrame (subreddit, sub_pos) that never visits the driver."""
    if isinstance(subreddits, DataFrame):
        order = subreddits.select(F.lower("subreddit").alias("_sub_key"), F.col("sub_pos").cast("int").alias("sub_pos"))
    else:
        names = [x.strip() for x in subreddits if x.strip()]
        order = posts.sparkSession.createDataFrame([(x.lower(), i + 1) for i, x in enumerate(names)],
                                                   "_sub_key string, sub_pos int")
    per_sub = max(1, target_count // max(1, order.count()))
    p = posts.withColumn("_sub_key", F.lower("subreddit")).join(order, "_sub_key").drop("_sub_key")
    listed = list_posts(p, mode, per_subreddit_limit, time_filter, query, as_of)
    listed = listed.where(T.has_text("title", "selftext"))
    first = dedup_first_seen(listed, ["sub_pos", "listing_rank"])
    ws = Window.partitionBy("sub_pos").orderBy("listing_rank")
    ranked = first.withColumn("sub_rank", F.row_number().over(ws))
    kept = _cap_by_prefix(ranked, "subreddit", "sub_pos", "sub_rank", per_sub, target_count)
    labeled = assign_label(kept, None, label_mode)
    return serialize_posts(labeled, include_title, full, keep=["sub_pos", "sub_rank", "label"])
