"""Hyper-parameter search that learns (M06): successive halving with warm
starts, and density ratios for the next points.

A bracket starts many points on a small share of the training rows, keeps the
best ``1 / eta`` of them for the next larger share, and so on; a survivor goes
on from the weights it had. The first bracket's points are random; later ones
are drawn near good trials: per parameter, a density of the better trials is
divided by that of the others, and of many seeded draws the one with the
highest product of ratios is taken. Everything is seeded: reruns give the same
trial table.

The trial table has a row per trial and rung and stays tiny; each evaluation is
a distributed fit. ``evaluate(params, share, start) -> (score, state)`` is the
caller's; :func:`classic_evaluator` fits TF-IDF and logistic regression.

Edge cases: equal scores keep the earlier trial; an evaluation that cannot be
fitted scores 0 with its reason; a bracket of one point has a single survivor.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import newton
from .classify import label_indexer, with_weights
from .common import materialize
from .features import TfidfParams, corpus_term_stats, fit_vocabulary, tfidf_transformer
from .metrics import summary
from .search import FIT_ERRORS, SPACE, _lr_params, _tfidf_params

GOOD = 0.3                 # share of trials that count as good
DRAWS = 24
TRIALS = "bracket int, trial int, rung int, share double, params map<string,string>, score double, message string"


def uniform(seed: int, *key) -> float:
    """In [0, 1), from a hash of the key."""
    h = hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()
    return int(h[:8], 16) / 2 ** 32


def draw(space: dict, u: Callable[[str], float]) -> dict[str, str]:
    """One point of a search space; ``u(name)`` gives each parameter's uniform."""
    out: dict[str, str] = {}
    for name, spec in space.items():
        x, kind = u(name), spec[0]
        if kind == "int":
            out[name] = str(spec[1] + int(x * (spec[2] - spec[1] + 1)))
        elif kind == "int_from":
            low = int(out[spec[1]])
            out[name] = str(low + int(x * (spec[2] - low + 1)))
        elif kind == "float":
            out[name] = repr(spec[1] + x * (spec[2] - spec[1]))
        elif kind == "log":
            out[name] = repr(math.exp(math.log(spec[1]) + x * math.log(spec[2] / spec[1])))
        else:
            options = spec[1] if kind == "cat" else spec[2][out[spec[1]]]
            out[name] = options[int(x * len(options))]
    return out


def place(spec, value: str) -> float | None:
    """A numeric parameter's place in [0, 1]; None for a choice."""
    if spec[0] == "log":
        return math.log(float(value) / spec[1]) / math.log(spec[2] / spec[1])
    if spec[0] == "float":
        return (float(value) - spec[1]) / (spec[2] - spec[1])
    if spec[0] == "int":
        return (int(value) - spec[1]) / max(1, spec[2] - spec[1])
    return None


def density(spec, values: Sequence[str], at: str) -> float:
    """Density of a parameter over trials: kernels for numbers, smoothed
    shares for choices."""
    p = place(spec, at)
    if p is None:
        return (sum(v == at for v in values) + 0.5) / (len(values) + 1.0)
    width = max(0.08, 0.5 * len(values) ** -0.2 / 2)
    return 0.1 + sum(math.exp(-0.5 * ((p - place(spec, v)) / width) ** 2) for v in values) / max(1, len(values)) / width


def next_points(space: dict, history: list[tuple[dict, float]], n: int, seed: int, first: int = 0) -> list[dict]:
    """Points by density ratio; random ones while there is nothing to learn."""
    ranked = sorted(range(len(history)), key=lambda i: (-history[i][1], i))
    cut = max(1, math.ceil(GOOD * len(ranked)))
    good, rest = [history[i][0] for i in ranked[:cut]], [history[i][0] for i in ranked[cut:]]
    out = []
    for k in range(first, first + n):
        if not rest:
            out.append(draw(space, lambda name: uniform(seed, k, name)))
            continue
        tried = []
        for d in range(DRAWS):
            base = good[int(uniform(seed, k, d, "pick") * len(good))]

            def near(name, base=base, d=d):
                p = place(space[name], base[name]) if name in base else None
                u = uniform(seed, k, d, name)
                if p is None or d % 4 == 0:                   # every fourth draw is a free one
                    return u
                return min(max(p + 0.3 * (u - 0.5), 0.0), 1 - 1e-9)
            point = draw(space, near)
            ratio = sum(math.log(density(s, [g[m] for g in good if m in g], point[m]) / density(s, [r[m] for r in rest if m in r], point[m]))
                        for m, s in space.items())
            tried.append((ratio, -d, point))
        out.append(max(tried, key=lambda t: t[:2])[2])
    return out


def halving_search(spark: SparkSession, evaluate, space: dict = SPACE, points: int = 9, shares: Sequence[float] = (0.25, 0.5, 1.0),
                   eta: int = 3, brackets: int = 2, seed: int = 42) -> DataFrame:
    """The trial table of all brackets (TRIALS)."""
    rows, history, trial = [], [], 0
    for bracket in range(brackets):
        alive = []
        for p in next_points(space, history, points, seed, trial):
            alive.append((trial, p, None))
            trial += 1
        for rung, share in enumerate(shares):
            done = []
            for t, p, start in alive:
                try:
                    score, state, message = *evaluate(p, share, start), None
                except FIT_ERRORS as e:
                    score, state, message = 0.0, None, f"{type(e).__name__}: {e}"[:300]
                done.append((t, p, state, score))
                rows.append((bracket, t, rung, float(share), p, float(score), message))
            done.sort(key=lambda d: (-d[3], d[0]))
            if rung + 1 < len(shares):
                alive = [d[:3] for d in done[:max(1, len(done) // eta)]]
            # a trial's last rung tells most of it; ended trials stay below their survivors
            ended = done if rung + 1 == len(shares) else done[max(1, len(done) // eta):]
            history += [(d[1], rung + d[3]) for d in ended]
    return spark.createDataFrame(rows, TRIALS)


def best_of(trials: DataFrame) -> DataFrame:
    """The best trial among those that reached the largest share (ties: the
    lowest trial)."""
    top = trials.agg(F.max("share")).first()[0]
    key = F.struct("score", -F.col("trial"))
    return trials.where(F.col("share") == top).groupBy().agg(F.max_by(F.struct(*trials.columns), key).alias("b")).select("b.*")


def classic_evaluator(train: DataFrame, val: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id",
                      most_terms: int = 200_000, seed: int = 42):
    """Fits a point on a seeded share of the training rows from given weights
    and scores the validation rows by macro-F1. Terms are counted once per
    n-gram range, over the whole training part, so a point keeps its
    vocabulary from rung to rung."""
    n_docs, stats, vectors = train.count(), {}, {}
    idx, seen = label_indexer(train, label_col, unseen="error"), label_indexer(train, label_col)
    classes = len(idx.labels)

    def evaluate(params: dict, share: float, start):
        tp = _tfidf_params(params)
        key = (tp.ngram_min, tp.ngram_max)
        if key not in stats:
            stats[key] = materialize(corpus_term_stats(train, TfidfParams(*key), id_col, text_col), "term-stats")
        bound = replace(tp, max_features=tp.max_features or most_terms)
        name = (key, tp.min_df, tp.max_df, bound.max_features)
        if name not in vectors:
            tfm = tfidf_transformer(fit_vocabulary(stats[key], n_docs, bound), bound, text_col)
            keep = (id_col, "features", "label_id", label_col)
            vectors[name] = [materialize(i.transform(tfm.transform(d)).select(*keep), "vectors") for i, d in ((idx, train), (seen, val))]
        tr, va = vectors[name]
        part = tr.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1000)) < int(1000 * share))
        lp = _lr_params(params)
        rows, _ = with_weights(part, label_col, lp.balanced)
        size = tr.select(F.unwrap_udt("features")["size"].alias("n")).first()["n"]                 # sparse vectors
        if not size:
            raise ValueError("no term left")
        got = newton.fit(rows, classes, size, lp.C, lp.penalty, lp.one_vs_rest, most=lp.max_iter, start=start)
        scored = newton.predicted(va, got.weights)
        return float(summary(scored).first().f1_macro_union), got.weights
    return evaluate

