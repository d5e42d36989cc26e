"""Post collection operators."""
import pytest
from pyspark.sql import functions as F

from topicflow.operators import collect
from topicflow.sources import derive

SF = "/root/testdata/sf0.001"


def test_listing_errors(spark):
    posts = derive.posts(spark, SF)
    with pytest.raises(ValueError):
        collect.list_posts(posts, "bogus")
    with pytest.raises(ValueError):
        collect.list_posts(posts, "search", query=None, time_filter="all")


def test_listing_uses_partial_group_limit(spark):
    posts = derive.posts(spark, SF)
    plan = collect.list_posts(posts, "new", 5, "all")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_mode_and_limits(spark):
    posts = derive.posts(spark, SF)
    hot = collect.list_posts(posts, "hot", 3, "all")
    assert hot.groupBy("subreddit").count().where(F.col("count") > 3).count() == 0


def test_dedup_and_quotas(spark):
    posts = derive.posts(spark, SF)
    tm = derive.topic_map(spark, SF)
    out = collect.collect_by_topic(posts, tm, target_count=50, per_subreddit_limit=10, time_filter="all")
    rows = out.collect()
    assert len(rows) <= 50
    assert len({r.id for r in rows}) == len(rows)
    per_topic = {}
    for r in rows:
        per_topic[r.topic] = per_topic.get(r.topic, 0) + 1
    assert max(per_topic.values()) <= max(1, 50 // tm.count())


def test_label_modes(spark):
    df = spark.createDataFrame([("Physics", " Quantum ", None), ("other", None, None), ("Physics", "  ", None)],
                               "subreddit string, link_flair_text string, x string")
    inv = spark.createDataFrame([("physics", "Science")], "sub_key string, bucket string")
    h = [r.label for r in collect.assign_label(df, inv, "hybrid").collect()]
    s = [r.label for r in collect.assign_label(df, inv, "subreddit").collect()]
    assert h == ["Quantum", "other", "Science"]
    assert s == ["Science", "other", "Science"]


def test_listing_on_plain_posts_table(spark):
    posts = derive.posts(spark, SF, with_copies=False).drop("copy")
    out = collect.list_posts(posts, "top", 2, "all")
    assert out.groupBy("subreddit").count().where(F.col("count") > 2).count() == 0
