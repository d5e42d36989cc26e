"""Document quality by Bradley-Terry pairwise ranking.

1. Every text is described by numbers of its letters, signs, words and lines.
2. Preference pairs (a row of label 1 is preferred to one of label 0) are drawn
   among all labelled rows: equal descriptions are one row with their count as
   weight, rows are dealt into blocks by a hash, and every row meets PER_ROW
   rows of the other label in its block (rows of the rarer label are in several
   blocks, so that no block lacks them). The Bradley-Terry model says the
   preferred one wins with the logistic function of the difference of two
   scores; with scores linear in the features this is a ridge logistic loss on
   feature differences, solved by Newton steps whose sums are Spark jobs.
3. Scores of rows left out of a fold's fit, counted for all labelled rows in
   steps of 1 / STEPS of the weights' length, give the level of the score
   quantile below which texts are of low quality (the level with the fewest
   errors, both labels weighing the same) and the slope by which scores become
   probabilities. The quantile itself is the probability THRESHOLD.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0;
labels, lang, source and doc_id are never inputs of a score. All labelled rows
are learned from; scores cover all rows and whole texts.

Edge cases: null and empty texts have all features 0; a null doc_id counts as
the empty text in the crc; of several labels of one id the least counts, null
labels and labels of unknown ids are ignored; without labels of both kinds
every score is the share of label 1 (0.0 without any); repeated rows are scored
each; empty tables give an empty result; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

PAIRS = 200_000            # most pairs of a fit on arrays
PER_ROW = 10               # pairs of each row of a block's commoner label
BLOCK = 2048               # rows of the commoner label in a block
LEAST = 256                # rows of the rarer label in a block, if there are as many
STEPS = 4096               # counted steps of a score
BLOCKS_READ = 8            # blocks of an Arrow batch
RIDGE = 1e-3
FOLDS = 5
THRESHOLD = 0.3            # probability of the quantile that parts the labels
SEED = 13

# --- 1. features

LETTER, UPPER, DIGIT, BLANK, LINE, POINT, SIGN = range(7)
KIND = np.full(256, SIGN, np.uint8)
KIND[[ord(c) for c in ".,;:?!'\"()-"]] = POINT
KIND[[9, 11, 12, 13, 32]] = BLANK
KIND[10] = LINE
KIND[48:58] = DIGIT
KIND[65:91] = UPPER
KIND[97:123] = LETTER
KIND[128:] = LETTER                                          # bytes of letters beyond ASCII
FEATURES = ("log_words", "upper", "digits", "signs", "points", "exclaims", "spaces", "line_length", "word_length", "long_words",
            "distinct_words", "top_word", "same_again", "distinct_pairs", "bare_signs", "sign_ends", "upper_words", "repeated_lines",
            "variety", "short_words")


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def distinct(row: np.ndarray, value: np.ndarray, n: int):
    """Different values per row, and the count of the most frequent one."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    key, count = np.unique(row * (int(value.max()) + 1) + value, return_counts=True)
    owner = key // (int(value.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, minlength=n).astype(float), most


def coded(lists: pa.Array):
    """(values of the flattened lists, code of each, row of each)."""
    first = lists.offsets[0].as_py()
    flat = lists.values.slice(first, lists.offsets[-1].as_py() - first).dictionary_encode()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def describe(text: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    text = text.fill_null("").cast(pa.string())
    n = len(text)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    cut = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + n + 1].astype(np.int64)
    body = data[cut[0]:cut[-1]]
    cut = cut - cut[0]
    chars = np.diff(cut).astype(float)
    kinds = KIND[body]

    def count(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[cut]).astype(float)
    by = [count(kinds == k) for k in range(7)]
    letters = by[LETTER] + by[UPPER]

    names, code, row = coded(pc.ascii_split_whitespace(text))
    some = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, bool)
    code, row = code[some[code]], row[some[code]]            # splitting leaves empty words at the ends
    words = np.bincount(row, minlength=n).astype(float)

    def of_words(flag):
        return np.bincount(row, np.asarray(flag, float)[code] if len(code) else None, minlength=n).astype(float)
    size = pc.utf8_length(names).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0)
    lower = pc.match_substring_regex(names, r"[a-z]").to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, bool)
    has_letter = pc.match_substring_regex(names, r"\pL").to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, bool)
    sign_end = pc.match_substring_regex(names, r"[^\pL\pN.,;:?!'\")\]-]$").to_numpy(zero_copy_only=False) if len(names) else lower
    many, most = distinct(row, code, n)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    pair = np.zeros(len(code), np.int64)
    pair[1:] = code[1:] * (int(code.max(initial=0)) + 1) + code[:-1]
    first = np.ones(len(code), bool)
    first[1:] = row[1:] != row[:-1]
    pair_id = np.unique(pair[~first], return_inverse=True)[1] if len(code) else pair
    pairs, _ = distinct(row[~first], pair_id, n)
    pair_total = np.bincount(row[~first], minlength=n)
    _, line, line_row = coded(pc.split_pattern(text, "\n"))
    lines = np.bincount(line_row, minlength=n)
    kinds_of_lines, _ = distinct(line_row, line, n)
    return np.column_stack([
        np.log1p(words), share(by[UPPER], letters), share(by[DIGIT], chars), share(by[SIGN], chars), share(by[POINT], chars),
        share(count(body == ord("!")), chars), share(by[BLANK], chars), np.log1p(share(chars, lines)), share(of_words(size), words),
        share(of_words(size > 20), words), share(many, words), share(most, words),
        share(np.bincount(row, again.astype(float), minlength=n), words), share(pairs, pair_total), share(of_words(~has_letter), words),
        share(of_words(sign_end), words), share(of_words(has_letter & ~lower & (size > 1)), words),
        1 - share(kinds_of_lines, lines), np.log1p(many) / np.maximum(np.log1p(words), 1e-9) * (words > 0),
        share(of_words(size <= 4), words)])


# --- 2. Bradley-Terry


def draw_pairs(y: np.ndarray, most: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places of preferred and other rows; each row takes part."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(seed)
    n = min(most, max(len(good), len(bad)) * 20)
    return good[draw.permutation(n) % len(good)], bad[draw.permutation(n) % len(bad)]


class Newton:
    """Damped Newton steps to a minimum: ``take`` gets the mean loss, gradient
    and Hessian at ``at`` and chooses the next place to ask for."""

    def __init__(self, width: int, ridge: float = RIDGE):
        self.w = self.at = np.zeros(width)
        self.ridge, self.now, self.rate, self.done = ridge, np.inf, 1.0, False

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        loss = loss + self.ridge / 2 * self.at @ self.at
        if loss > self.now and self.rate > 1e-6:
            self.rate /= 2
        else:
            gain, self.w, self.now = self.now - loss, self.at, loss
            self.move = np.linalg.solve(hessian + self.ridge * np.eye(len(self.w)), gradient + self.ridge * self.w)
            self.rate, self.done = 1.0, gain < 1e-12
        self.at = self.w if self.done else self.w - self.rate * self.move


def pair_sums(d: np.ndarray, weight: np.ndarray, w: np.ndarray):
    """Weighted sums of log(1 + exp(-d w)), its gradient and its Hessian."""
    z = d @ w
    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
    return (weight * np.logaddexp(0, -z)).sum(), -(d.T @ (weight * p)), (d * (weight * p * (1 - p))[:, None]).T @ d


def fit_strengths(x: np.ndarray, y: np.ndarray, most: int = PAIRS, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-(x_win - x_lose) w))
    plus ridge / 2 * |w|^2, by damped Newton steps."""
    win, lose = draw_pairs(y, most)
    d = x[win] - x[lose]
    fit = Newton(x.shape[1], ridge)
    for _ in range(steps):
        fit.take(*pair_sums(d, np.full(len(d), 1 / len(d)), fit.at))
        if fit.done:
            break
    return fit.w


def level_of(score: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> float:
    """Quantile level that parts the labels with the least balanced error;
    the median of the levels that do equally well. ``count``: rows of each score."""
    count = np.ones(len(score)) if count is None else count
    order = np.argsort(score, kind="stable")
    s, good, bad = score[order], (count * (y == 1))[order], (count * (y == 0))[order]
    wrong = np.concatenate([[0], np.cumsum(good)]) / good.sum() + 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    ends = np.concatenate([[True], s[1:] > s[:-1], [True]])   # ties can't be parted
    wrong = np.where(ends, wrong, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((good + bad)[:best[len(best) // 2]].sum() / count.sum())


def quantile_of(score: np.ndarray, count: np.ndarray, level: float) -> float:
    """Middle between the last score of the share ``level`` and the next one."""
    order = np.argsort(score, kind="stable")
    s, below = score[order], np.cumsum(count[order])
    k = int(np.searchsorted(below, level * below[-1] - 1e-6 * count.min()))
    last = level > 0 and k + 1 < len(s) and below[k] <= level * below[-1] + 0.5 * count.min()
    return float((s[k] + s[k + 1]) / 2 if last else s[k])


def slope_of(score: np.ndarray, y: np.ndarray, at: float, count: np.ndarray | None = None) -> float:
    """Slope of the logistic curve through THRESHOLD at ``at`` that fits best."""
    count = np.ones(len(score)) if count is None else count
    side = np.log(THRESHOLD / (1 - THRESHOLD))
    mean = np.average(score, weights=count)
    spread = max(np.sqrt(np.average((score - mean) ** 2, weights=count)), 1e-9)
    tried = np.geomspace(0.1, 30, 40) / spread
    sign = np.where(y == 1, -1.0, 1.0)
    weight = count * np.where(y == 1, 0.5 / count[y == 1].sum(), 0.5 / count[y == 0].sum())
    return float(min(tried, key=lambda a: (weight * np.logaddexp(0, sign * (a * (score - at) + side))).sum()))


class Ranking:
    """Standardised features, strengths, and the map to probabilities; from
    arrays, or with ``of`` from what the jobs below found."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int = PAIRS):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self.standard(x)
        fold = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
        aside = np.full(len(y), np.nan)
        for k in range(FOLDS):
            if len(set(y[fold != k])) == 2:
                aside[fold == k] = z[fold == k] @ fit_strengths(z[fold != k], y[fold != k], most)
        self.weights = fit_strengths(z, y, most)
        self.place(np.where(np.isnan(aside), z @ self.weights, aside), y, np.ones(len(y)))

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray) -> "Ranking":
        r = cls.__new__(cls)
        r.mean, r.scale = mean, scale
        return r

    def place(self, aside: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        """Level and slope from scores of rows left out of the fit."""
        self.at = quantile_of(aside, count, level_of(aside, y, count))
        self.slope = slope_of(aside, y, self.at, count)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.standard(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.at) + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


class Constant:
    """Scores without labels of both kinds."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


# --- 3. Spark jobs

DESCRIBED = "doc_id long, held_out boolean, x array<double>"


def feature_batches(batches):
    for batch in batches:
        for b in T.slices(batch, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(describe(b.column(2))), pa.list_(pa.float64()))],
                                             ["doc_id", "held_out", "x"])


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of features of a column of lists."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(FEATURES))


def score_batches(model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(matrix(b.column(2))), pa.float64())],
                                             ["doc_id", "held_out", "score"])
    return run


def moments(batches):
    """Sums of the count, the features and their squares of a task's rows."""
    total = np.zeros(1 + 2 * len(FEATURES))
    for b in batches:
        x, n = matrix(b.column(0)), b.column(1).to_numpy().astype(float)
        total += np.concatenate([[n.sum()], n @ x, n @ (x * x)])
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])


def block_sums(model: Ranking, places: dict[int, np.ndarray]):
    """Of the pairs of a task's blocks: weight, loss, gradient and Hessian at
    each fit's place. Fit k leaves the rows of fold k out, fit FOLDS none."""
    def run(batches):
        total = None
        for batch in batches:
            for block in batch.column(0):
                r = block.values
                order = np.argsort(r.field("h").to_numpy(), kind="stable")
                y, n, fold = (r.field(c).to_numpy()[order] for c in ("y", "n", "fold"))
                if len(set(y.tolist())) < 2:
                    continue
                z = model.standard(matrix(r.field("x")))[order]
                win, lose = draw_pairs(y, PER_ROW * int(max((y == 1).sum(), (y == 0).sum())))
                d, weight = z[win] - z[lose], n[win].astype(float) * n[lose]
                sums = []
                for k, w in places.items():
                    use = (fold[win] != k) & (fold[lose] != k)
                    loss, gradient, hessian = pair_sums(d[use], weight[use], w)
                    sums += [[weight[use].sum(), loss], gradient, hessian.ravel()]
                total = np.concatenate(sums) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])
    return run


def fit_blocks(blocks: DataFrame, model: Ranking, steps: int = 50) -> list[np.ndarray]:
    """Weights of every fit, FOLDS without a fold each and one of all rows;
    one job over all blocks gives a step of every fit."""
    width = len(FEATURES)
    fits = {k: Newton(width) for k in range(FOLDS + 1)}
    for _ in range(steps):
        open_ = {k: f for k, f in fits.items() if not f.done}
        if not open_:
            break
        sums = C.added(blocks.mapInArrow(block_sums(model, {k: f.at for k, f in open_.items()}), "sums array<double>"))
        for f, part in zip(open_.values(), sums.reshape(len(open_), -1)):
            if part[0] > 0:
                mean = part[1:] / part[0]
                f.take(mean[0], mean[1:1 + width], mean[1 + width:].reshape(width, width))
            else:                                            # no pair without this fold: the fit of all rows serves
                f.done, f.w = True, None
    whole = fits[FOLDS].w
    return [np.round(whole if f.w is None else f.w, 9) for f in fits.values()]      # sums come in any order


def aside_steps(model: Ranking, weights: list[np.ndarray], step: float):
    """Steps of the scores of rows, each by the fit that left its fold out."""
    def run(batches):
        own = np.stack(weights[:FOLDS])
        for b in batches:
            s = (model.standard(matrix(b.column(0))) * own[b.column(2).to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s / step).astype(np.int64)), b.column(3), b.column(1)], ["at", "y", "n"])
    return run


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(described: DataFrame, labels: DataFrame) -> Ranking | Constant:
    """From all labelled rows of a written table of DESCRIBED."""
    lab = (labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") > 0).cast("long")).alias("y")))
    rows = C.materialize(described.join(lab, "doc_id").groupBy("x", "y").agg(F.count("*").alias("n"))
                         .withColumn("fold", F.expr(f"pmod(xxhash64(x, {SEED}), {FOLDS})")), "labelled")
    of = {r["y"]: r for r in rows.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    if len(of) < 2:
        return Constant(float(max(of, default=0)))
    sums = C.added(rows.select("x", "n").mapInArrow(moments, "sums array<double>"))
    mean, square = np.split(sums[1:] / sums[0], 2)
    model = Ranking.of(mean, np.maximum(np.sqrt(np.maximum(square - mean ** 2, 0)), 1e-6))
    dealt = C.deal(rows.withColumn("h", F.xxhash64("x", "y")), F.col("y"), F.xxhash64("x"), {k: r["rows"] for k, r in of.items()},
                   BLOCK, LEAST)
    with C.small_batches(rows.sparkSession, BLOCKS_READ):
        blocks = C.materialize(dealt.repartition(C.partitions(rows.sparkSession), "block").groupBy("block").agg(F.collect_list(F.struct("h", "y", "n", "fold", "x")).alias("rows"))
                               .select("rows"), "blocks")
        weights = fit_blocks(blocks, model)
    model.weights = weights[FOLDS]
    step = max(max(np.linalg.norm(w) for w in weights), 1e-9) / STEPS      # features are clipped: at most 36 * 2 * STEPS steps
    got = (rows.select("x", "n", "fold", "y").mapInArrow(aside_steps(model, weights, step), "at long, y long, n long")
           .groupBy("at", "y").agg(F.sum("n").alias("n")).orderBy("at", "y").collect())
    at, y, n = (np.array([r[k] for r in got], float) for k in range(3))
    model.place(at * step, y, n)
    return model


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("body"))
    described = C.materialize(rows.mapInArrow(feature_batches, DESCRIBED), "described")
    out = described.mapInArrow(score_batches(train(described, labels)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op13_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


QUERIES = {"op13_pairwise_quality": op13_pairwise_quality}
ORACLES: dict[str, str] = {}
