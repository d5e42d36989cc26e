"""Successive halving and density ratios on known surfaces."""
import math

import pytest

from topicflow.operators import halving as H

SPACE = {"a": ("float", 0.0, 1.0), "c": ("log", 0.01, 100.0), "k": ("int", 1, 9), "m": ("int_from", "k", 12),
         "s": ("cat", ["p", "q", "r"]), "t": ("cond", "s", {"p": ["1", "2"], "q": ["3"], "r": ["4"]})}


def surface(p):
    """Best at a = 0.7, c = 3, k = 4, s = q."""
    return (math.exp(-8 * (float(p["a"]) - 0.7) ** 2) * math.exp(-0.3 * math.log(float(p["c"]) / 3) ** 2)
            * math.exp(-0.1 * (int(p["k"]) - 4) ** 2) * (1.0 if p["s"] == "q" else 0.5))


def evaluator(calls):
    def evaluate(p, share, start):
        calls.append((share, start))
        return surface(p) * (0.6 + 0.4 * share), share
    return evaluate


def test_points_lie_in_the_space():
    for k in range(200):
        p = H.draw(SPACE, lambda n, k=k: H.uniform(1, k, n))
        assert 0 <= float(p["a"]) <= 1 and 0.01 <= float(p["c"]) <= 100 and 1 <= int(p["k"]) <= int(p["m"]) <= 12
        assert p["t"] in SPACE["t"][2][p["s"]]


def test_rungs_shrink_and_starts_are_warm(spark):
    calls = []
    t = H.halving_search(spark, evaluator(calls), SPACE, points=9, brackets=2, seed=3)
    sizes = {(r.bracket, r.rung): r.n for r in t.groupBy("bracket", "rung").count().withColumnRenamed("count", "n").collect()}
    assert sizes == {(b, r): n for b in (0, 1) for r, n in enumerate((9, 3, 1))}
    assert [s for share, s in calls if share == 0.25] == [None] * 18 and all(s == 0.25 for share, s in calls if share == 0.5)
    again = H.halving_search(spark, evaluator([]), SPACE, points=9, brackets=2, seed=3)
    assert t.select("trial", "rung", "score").collect() == again.select("trial", "rung", "score").collect()
    best = H.best_of(t).first()
    assert best.share == 1.0 and best.score == max(r.score for r in t.where("share = 1.0").collect())


def test_beats_random_points_of_equal_budget():
    """Budget in shares of the rows: 4 brackets of 9 points cost as much as 19
    random points fitted in full."""
    learned, random_ = [], []
    for seed in range(12):
        history, best = [], 0.0
        for bracket in range(4):
            points = H.next_points(SPACE, history, 9, seed, 9 * bracket)
            ranked = sorted(points, key=surface, reverse=True)
            history += [(p, surface(p)) for p in points]
            best = max(best, surface(ranked[0]))
        learned.append(best)
        cost = 4 * (9 * 0.25 + 3 * 0.5 + 1)
        random_.append(max(surface(H.draw(SPACE, lambda n, k=k: H.uniform(seed + 100, k, n))) for k in range(math.ceil(cost))))
    assert sum(learned) > sum(random_) + 0.5 and sum(a > b for a, b in zip(learned, random_)) >= 9


def test_failed_trials_score_zero(spark):
    def bad(p, share, start):
        raise ValueError("no term left")
    t = H.halving_search(spark, bad, SPACE, points=3, brackets=1).collect()
    assert all(r.score == 0.0 and "no term left" in r.message for r in t) and len(t) == 5


def test_classic_points(spark):
    from pyspark.sql import functions as F
    from topicflow.plans import catalog
    data = catalog._labelled_split(spark, "/root/testdata/sf0.001", "tfidf").persist()
    evaluate = H.classic_evaluator(data.where(F.col("split") == "train"), data.where(F.col("split") == "val"))
    p = {"ngram_min": "1", "ngram_max": "1", "min_df": "2", "max_df": "0.9", "max_features": "5000", "C": "1.0", "max_iter": "500",
         "solver": "lbfgs", "class_weight": "balanced", "penalty": "l2"}
    low, w = evaluate(p, 0.5, None)
    high, w2 = evaluate(p, 1.0, w)
    cold, w3 = evaluate(p, 1.0, None)
    assert w.shape == w2.shape and high == pytest.approx(cold, abs=0.1) and high > 0.5 and abs(w2 - w3).max() < 0.05 * abs(w3).max() + 0.05
