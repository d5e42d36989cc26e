"""Table-resident model against the vector form and plain sums."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicflow.operators import classify, features, table_model as M

LABELS = ["x", "y", "z"]
PARAMS = features.TfidfParams(1, 2, min_df=2, max_df=1.0, max_features=None)


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(5)
    own = {"x": "apple pear plum", "y": "iron lead tin", "z": "dog cat cow"}
    rows = []
    for i in range(90):
        lab = LABELS[i % 3]
        words = list(draw.choice(own[lab].split(), 3)) + list(draw.choice("the of and one two three".split(), 4))
        rows.append((i, " ".join(words), lab))
    rows += [(900, "", "x"), (901, None, None), (902, "unseen words only", None), (903, "apple pear apple", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3).persist()


def test_scores_equal_the_vector_form(spark, docs):
    params = features.TfidfParams(1, 2, min_df=2, max_df=1.0, max_features=40)
    train = docs.where("label is not null")
    vocab = features.fit_tfidf(train, params)
    model = classify.train_classic(train, tfidf=params)
    lr = model.stages[-2]
    table = M.from_vector_model(vocab, lr.coefficientMatrix.toArray(), lr.interceptVector.toArray(), list(model.stages[-1].getLabels()), params)
    want = {r.doc_id: (r.rawPrediction.toArray(), r.predicted_label) for r in model.transform(docs.fillna("", ["text"])).collect()}
    got = {r.doc_id: r for r in M.scores(docs.fillna("", ["text"]), table).collect()}
    assert len(got) == len(want) == docs.count()
    for i, (raw, label) in want.items():
        assert np.allclose(got[i].scores, raw, atol=1e-9) and got[i].predicted_label == label


def test_fit_needs_no_bound_and_no_driver_vocabulary(spark, docs):
    model, history = M.fit_table(docs, LABELS, C=1.0, params=PARAMS, rounds=8, split_rows=20)
    assert all(b <= a + 1e-9 for a, b in zip(history, history[1:]))
    assert model.vocab.where("parts > 1").count() > 0                    # split terms give the same sums
    # the objective by plain sums, and the optimum by the vector solver on the same terms
    long = M.long_form(docs.where("label is not null"), model.vocab, PARAMS).toPandas()
    assert np.allclose(long.groupby("doc").x.apply(lambda v: (v ** 2).sum()), 1.0)
    terms = sorted(model.vocab.select("term").toPandas().term)
    w = {r.term: np.array(r.w) for r in model.weights.collect()}
    lab = {r.doc_id: LABELS.index(r.label) for r in docs.where("label is not null").collect()}
    x = np.zeros((len(lab), len(terms)))
    row = {d: i for i, d in enumerate(sorted(lab))}
    for d, t, v in zip(long.doc, long.term, long.x):
        x[row[d], terms.index(t)] += v
    y = np.array([lab[d] for d in sorted(lab)])
    wm = np.array([w[t] for t in terms])

    def objective(wm, b):
        z = x @ wm + b
        return sum(math.log(np.exp(r - r.max()).sum()) + r.max() - r[k] for r, k in zip(z, y)) + (wm ** 2).sum() / 2
    assert objective(wm, np.array(model.intercepts)) == pytest.approx(history[-1], rel=1e-6)
    from pyspark.ml.linalg import Vectors
    from topicflow.operators import newton
    rows = spark.createDataFrame([(Vectors.dense(v), float(k), 1.0) for v, k in zip(x, y)], ["features", "label_id", "weight"])
    best = newton.fit(rows, 3, len(terms), 1.0)
    assert history[-1] <= best.objective * 1.01
    got = {r.doc_id: r.predicted_label for r in M.scores(docs.fillna("", ["text"]), model).collect()}
    assert np.mean([got[d] == LABELS[k] for d, k in lab.items() if d != 900]) > 0.95 and got[903] == "x"
    assert got[902] == got[901] == LABELS[int(np.argmax(model.intercepts))]
    with pytest.raises(ValueError, match="no labelled"):
        M.fit_table(docs.where("label = 'none'"), LABELS, params=PARAMS)
