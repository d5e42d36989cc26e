"""Jobs that must see every row, within bounded memory."""
from collections import Counter

import pyarrow as pa

from topicflow.operators import features


def test_terms_are_counted_in_slices(spark, monkeypatch):
    docs = [(1, "one two three two three"), (1, "two three"), (2, ""), (3, None), (None, "x1 one two"), (4, "é a Éa éa " * 40), (5, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)

    def grams(text):
        w = [x for x in (text or "").lower().split() if len(x) > 1]
        return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    want = Counter((d, t, n) for d, text in docs for t, n in Counter(grams(text)).items())
    cf, seen = Counter(t for _, text in docs for t in grams(text)), Counter(t for _, text in docs for t in set(grams(text)))
    for most in (features.SLICE_TERMS, 3):                     # a long row is a slice of its own
        monkeypatch.setattr(features, "SLICE_TERMS", most)
        words = features.with_terms(df, ngram_max=1)
        assert Counter(map(tuple, features.term_frequencies(words, ngrams=(1, 3)).collect())) == want
        parts = features.term_frequencies(words, ngrams=(1, 3), per_doc=False)
        assert {r.term: (r.df, r.cf) for r in features.term_stats(parts).collect()} == {t: (seen[t], cf[t]) for t in cf}
        stats = features.corpus_term_stats(df, features.TfidfParams(2, 3))
        assert {r.term: (r.df, r.cf) for r in stats.collect()} == {t: (seen[t], cf[t]) for t in cf if " " in t}


def test_a_slice_bounds_what_a_task_holds():
    """Before, all n-grams of an Arrow batch (10,000 texts) were grouped at once."""
    lists = pa.array([["a"] * k for k in (30, 60, 20, 250, 5, 0, 95, 1)] + [None], pa.list_(pa.string())).slice(1)
    got = [(start, len(part), len(part.flatten())) for part, start in features._slices(lists, 100)]
    assert got == [(0, 2, 80), (2, 1, 250), (3, 3, 100), (6, 2, 1)]


def test_block_products_hold_no_row_per_word_and_class():
    """Before, a product held words x classes at once, gathered across the weights."""
    import tracemalloc

    import numpy as np

    from topicflow.operators.newton import Block
    draw = np.random.default_rng(1)
    size = draw.integers(0, 300, 400)
    size[[0, 7, 399]] = 0                                     # rows without words
    at, value = draw.integers(0, 500, size.sum()).astype(np.int32), draw.random(size.sum())
    b = Block([400, np.append(0, np.cumsum(size)).astype(np.int64).tobytes(), at.tobytes(), value.tobytes(),
               draw.integers(0, 30, 400).tobytes(), np.ones(400).tobytes()])
    x = np.zeros((400, 500))
    np.add.at(x, (np.repeat(np.arange(400), size), at), value)
    w, r = draw.random((30, 501)), draw.random((400, 30))
    tracemalloc.start()
    z, g = b.margins(w), b.spread(r, 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(z, x @ w[:, :-1].T + w[:, -1]) and np.allclose(g, np.hstack([(x.T @ r).T, r.sum(axis=0)[:, None]]))
    assert peak < 8 * len(at) * 10                            # 30 classes


def test_embedding_is_fitted_on_every_row(spark):
    """Before, on 20,000 rows at most: words of the others had no vector."""
    from pyspark.sql import functions as F

    from topicflow.operators import classify
    n = 20_300                                                # each word is in two rows
    rows = spark.range(n).select(F.concat(F.lit("w"), F.floor(F.col("id") / 2)).alias("text"))
    _, w2v = classify.dense_features(rows, "text", classify.DenseParams(vector_size=2))
    assert w2v.getVectors().count() == n // 2


def test_an_epoch_is_few_jobs_and_equal_to_single_steps(spark, monkeypatch):
    """Before, each step of each epoch was a job of its own."""
    import numpy as np

    from topicflow.operators import epochs as E
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [int(k) for k in draw.integers(2, 30, i % 9)], int(draw.integers(3))) for i in range(300)] + [(5, [3, 4], 1)],
                                 "doc_id long, ids array<int>, y int").repartition(3)
    params = E.EpochParams(width=4, epochs=2, batch_rows=8)

    def jobs(run_rows, cells):
        monkeypatch.setattr(E, "RUN_ROWS", run_rows)
        monkeypatch.setattr(E, "DENSE_CELLS", cells)
        spark.sparkContext.setJobGroup(f"epochs-{run_rows}", "")
        _, table, folder = E.train_epochs(rows, rows, 30, ["a", "b", "c"], params)
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epochs-{run_rows}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        last = E.written_epochs(spark, folder).orderBy("epoch").collect()[-1]
        return done, E.State.unpacked(bytes(last["state"])), [r.loss for r in table.orderBy("epoch").collect()]
    few, state, loss = jobs(E.RUN_ROWS, E.DENSE_CELLS)
    some, state2, loss2 = jobs(16, E.DENSE_CELLS)             # runs of two steps
    many, state1, loss1 = jobs(8, 0)                          # a job per step, merged from tasks
    assert state.step == state1.step == state2.step > 40 and few < some < many and few < 40
    for other, l in ((state1, loss1), (state2, loss2)):
        assert all(np.allclose(state.weights[k], other.weights[k], atol=1e-12) for k in state.weights) and np.allclose(loss, l)


def test_scoring_holds_the_embeddings_of_few_rows():
    """Before, those of a whole Arrow batch: 10,000 rows of up to 256 ids."""
    import tracemalloc

    import numpy as np

    from topicflow.operators import epochs as E
    weights = E.fresh_state(50, 3, E.EpochParams()).weights
    ids = pa.array([[k % 50 for k in range(i, i + 200 * (i % 3))] for i in range(1500)], pa.list_(pa.int32())).slice(1)
    tracemalloc.start()
    p = E.probabilities(weights, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(p, E.softmax(E.bags(ids, weights["embed"])[0] @ weights["out"] + weights["bias"]))
    assert peak < 60e6 and E.probabilities(weights, ids.slice(0, 0)).shape == (0, 3)


def test_a_trial_without_max_features_has_every_term(spark):
    """Before, its vocabulary was cut to 200,000 terms."""
    import numpy as np
    from pyspark.sql import functions as F

    from topicflow.operators import search
    draw = np.random.default_rng(4)
    own = {"x": "apple pear plum", "y": "iron lead tin", "z": "dog cat cow"}
    texts = [(i % 50, " ".join([*draw.choice(own[k].split(), 2), *draw.choice("the of and one two".split(), 4)]), k) for i in range(40) for k in own]
    texts += [(None, "", "x"), (3, "unseen", "y")]            # rows without a known term, keys that repeat or are null
    train = spark.createDataFrame(texts, "doc_id long, text string, label string").repartition(3)
    val = spark.createDataFrame([*texts[:60], (900, "apple", "other"), (901, "", "z")], "doc_id long, text string, label string")
    params = features.TfidfParams(1, 2, 2, 1.0, None)
    vocab = features.fit_tfidf(train, params)
    rows = train.withColumn("n", F.monotonically_increasing_id()).localCheckpoint()
    got = {r.n: dict(zip(*r.features)) for r in features.table_vectors(rows, vocab, params, "n", ["n", "label"]).collect()}
    want = {r.n: dict(zip(r.features.indices.tolist(), r.features.values.tolist())) for r in features.tfidf_transformer(vocab, params).transform(rows).collect()}
    assert got.keys() == want.keys() and all(got[n].keys() == want[n].keys() and np.allclose([got[n][k] for k in want[n]], list(want[n].values())) for n in want)
    for solver in ("liblinear", "lbfgs"):
        space = {**search.SPACE, "ngram_min": ("int", 1, 1), "min_df": ("int", 2, 2), "max_df": ("float", 1.0, 1.0), "C": ("log", 5.0, 5.1), "solver": ("cat", [solver])}
        one, two = (search.random_search(train, val, 1, 3, space={**space, "max_features": ("cat", [m])}).collect() for m in ("None", "100000"))
        assert [r.most_features for r in one] == [None] and all(r.status == "ok" for r in one)
        assert [(r.val_f1, r.val_accuracy) for r in one] == [(r.val_f1, r.val_accuracy) for r in two]
    none = search.random_search(train, val, 1, 3, space={**space, "max_features": ("cat", ["None"]), "min_df": ("int", 999, 999)}).first()
    assert none.status == "failed" and "no term left" in none.message


def test_l1_steps_travel_without_the_features_at_rest():
    """Before, every weight an l1 step tried was as wide as the vocabulary."""
    import numpy as np

    from topicflow.operators import newton
    draw = np.random.default_rng(6)
    x = draw.random((200, 300)) * (draw.random((200, 300)) < 0.1)
    y = (x[:, 0] + x[:, 1] > x[:, 2] + 0.2).astype(np.int64)
    at = np.nonzero(x)
    b = newton.Block([200, np.append(0, np.cumsum((x != 0).sum(axis=1))).astype(np.int64).tobytes(), at[1].astype(np.int32).tobytes(), x[at].tobytes(),
                      y.tobytes(), np.ones(200).tobytes()])
    widths = []

    class Local(newton.Problem):
        def __init__(self):
            self.shape, self.one_vs_rest, self.passes = (2, 301), True, 0

        def _sum(self, run):
            self.passes += 1
            got = run(b)
            widths.append(len(got))
            return got

    only = np.array([0, 2, 7, 150])
    w = np.zeros((2, 301))
    w[:, [*only, 300]] = draw.random((2, 5))
    wide, own = Local(), [*only, 300]
    assert np.allclose(wide.losses([w]), wide.losses([w[:, own]], only))
    assert np.allclose(wide.hessian_times(w, w)[:, own], wide.hessian_times(w[:, own], w[:, own], only))
    widths.clear()
    got = newton.minimise_l1(Local(), 0.5, tol=1e-6)
    assert got.converged and 0 < (got.weights[:, :-1] != 0).sum() < 200
    z = x @ got.weights[:, :-1].T + got.weights[:, -1]
    r = newton.probabilities(z, True) - (np.arange(2) == y[:, None])
    g = np.vstack([x.T @ r, r.sum(axis=0)]).T
    k = got.weights[:, :-1]
    assert np.abs(g[:, -1]).max() < 1e-3 and (np.abs(g[:, :-1][k == 0]) <= 0.5 + 1e-3).all() and np.allclose(g[:, :-1][k != 0], -0.5 * np.sign(k[k != 0]), atol=1e-3)
    wide_ones = sum(n == 603 for n in widths)                 # gradients: 2 x 301 and the loss
    assert wide_ones < len(widths) / 2 and min(n for n in widths if n > 8) < 500
