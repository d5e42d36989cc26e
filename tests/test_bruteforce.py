"""Quota cascade: properties and hand-worked rows; metrics against plain Python."""
import random

from topicflow.operators import collect, metrics
from topicflow.sources import derive

SF = "/root/testdata/sf0.001"

POST = "id string, title string, selftext string, subreddit string, link_flair_text string, created_utc double, " \
       "permalink string, is_self boolean, over_18 boolean, num_comments int, score int, upvote_ratio double"
MAP = "topic string, subreddits array<string>, position int"


def _post(i, sub, score, title="t", body=""):
    return (i, title, body, sub, None, 1000.0, f"/{i}", True, False, 0, score, 0.5)


def test_topic_quotas_properties(spark):
    """Every topic stays within its quota, the whole within the target; ids are
    unique; ranks within a topic have no gap and follow subreddit order."""
    target, per_sub = 60, 6
    tm = derive.topic_map(spark, SF)
    quota = max(1, target // tm.count())
    rows = collect.collect_by_topic(derive.posts(spark, SF), tm, target_count=target, per_subreddit_limit=per_sub,
                                    time_filter="all").collect()
    assert 0 < len(rows) <= target and len({r.id for r in rows}) == len(rows)
    by_topic = {}
    for r in rows:
        by_topic.setdefault(r.topic, []).append(r)
    for own in by_topic.values():
        own.sort(key=lambda r: r.topic_rank)
        assert len(own) <= quota and [r.topic_rank for r in own] == list(range(1, len(own) + 1))
        subs = [r.subreddit for r in own]
        assert subs == sorted(subs, key=subs.index)                  # one block per subreddit
        assert max(subs.count(x) for x in set(subs)) <= per_sub
        for x in set(subs):
            scores = [r.score for r in own if r.subreddit == x]
            assert scores == sorted(scores, reverse=True)


def test_topic_quotas_by_hand(spark):
    """Quota 2 per topic (target 4, two topics). ``both`` is listed by the two
    topics' subreddits and belongs to the first; ``blank`` has no text; a
    shared subreddit's label is the last topic that lists it."""
    posts = spark.createDataFrame([
        _post("a1", "A", 9), _post("both", "A", 8), _post("a3", "A", 7),
        _post("both", "B", 99), _post("blank", "B", 50, title=" ", body=None), _post("b2", "B", 5), _post("b3", "B", 4),
        _post("b4", "B", 3)], POST)
    tm = spark.createDataFrame([("one", ["A"], 0), ("two", ["B"], 1)], MAP)
    got = sorted((r.topic, r.topic_rank, r.id) for r in collect.collect_by_topic(
        posts, tm, target_count=4, per_subreddit_limit=10, time_filter="all").collect())
    assert got == [("one", 1, "a1"), ("one", 2, "both"), ("two", 1, "b2"), ("two", 2, "b3")]
    # an id whose first topic is already full goes to no other topic: ids are settled before quotas
    got = sorted((r.topic, r.id) for r in collect.collect_by_topic(
        posts, tm, target_count=2, per_subreddit_limit=10, time_filter="all").collect())
    assert got == [("one", "a1"), ("two", "b2")]


def test_subreddit_under_two_topics(spark):
    tm = spark.createDataFrame([("one", ["A", "C"], 0), ("two", ["C"], 1)], MAP)
    got = {r.sub_key: r.bucket for r in collect.invert_topic_map(tm).collect()}
    assert got == {"a": "one", "c": "two"}


def _py_metrics(pairs, labels_mode):
    ys = [y for y, _ in pairs]
    ps = [p for _, p in pairs]
    labels = sorted(set(ys) | set(ps)) if labels_mode == "union" else sorted(set(ys))
    f1s = []
    for c in labels:
        tp = sum(1 for y, p in pairs if y == c and p == c)
        pred = sum(1 for p in ps if p == c)
        sup = sum(1 for y in ys if y == c)
        pr = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        f1s.append(2 * pr * rc / (pr + rc) if pr + rc else 0.0)
    return sum(f1s) / len(f1s), sum(1 for y, p in pairs if y == p) / len(pairs)


def test_metrics_match_bruteforce(spark):
    rnd = random.Random(13)
    for case in range(4):
        k = rnd.randint(2, 7)
        pairs = [(f"c{rnd.randrange(k)}", f"c{rnd.randrange(k + 1)}") for _ in range(rnd.randint(20, 300))]
        df = spark.createDataFrame(pairs, "y string, p string")
        m = metrics.summary(df).first()
        fu, acc = _py_metrics(pairs, "union")
        fp, _ = _py_metrics(pairs, "present")
        assert abs(m.accuracy - acc) < 1e-12 and abs(m.f1_macro_union - fu) < 1e-12
        assert abs(m.f1_macro_present - fp) < 1e-12, case
        grid = {(r.y, r.p): r.n for r in metrics.confusion_grid(df).collect()}
        present = sorted({y for y, _ in pairs})
        assert len(grid) == len(present) ** 2
        for (y, p), n in grid.items():
            assert n == sum(1 for a, b in pairs if a == y and b == p)
