"""Epoch trainer: gradients, AdamW, merging, resume, best epoch."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicflow.operators import epochs as E

LABELS = ["a", "b", "c"]
PARAMS = E.EpochParams(width=4, epochs=3, batch_rows=16)


def rows(spark, n=90, seed=0):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(draw.integers(3))
        ids = [int(k) for k in draw.integers(2, 20, draw.integers(0, 6))] + [20 + y] * int(draw.integers(1, 3))
        out.append((i, ids if i % 17 else [], y if i % 29 else None))
    return spark.createDataFrame(out, "doc_id long, ids array<int>, y int").repartition(4)


def test_gradient_is_numeric_gradient():
    state = E.fresh_state(9, 3, PARAMS)
    ids, y = pa.array([[1, 2, 2, 8], [], [5], [8, 1]], pa.list_(pa.int32())), np.array([0, 1, 2, 2])
    loss, used, emb, out, bias = E.gradient(state.weights, ids, y)
    full = {"embed": np.zeros((9, 4)), "out": out, "bias": bias}
    full["embed"][used] = emb
    for name, g in full.items():
        for at in np.ndindex(g.shape):
            old = state.weights[name][at]
            got = []
            for e in (1e-5, -1e-5):
                state.weights[name][at] = old + e
                got.append(E.gradient(state.weights, ids, y)[0])
            state.weights[name][at] = old
            assert (got[0] - got[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6)
    assert set(used) == {1, 2, 5, 8}


def test_merged_gradients_equal_one_task(spark):
    state = E.fresh_state(23, 3, PARAMS)
    data = rows(spark).where("y is not null").select("ids", F.col("y").cast("long").alias("y"))
    one, many, tree = (E.batch_gradient(data.repartition(n), state.weights, fan) for n, fan in ((1, 32), (7, 32), (7, 2)))
    for a, b, c in zip(one, many, tree):
        assert np.allclose(a, b) and np.allclose(a, c)


def test_schedule():
    p = E.EpochParams(learning_rate=1.0, warmup_ratio=0.2)
    assert [round(E.rate_at(s, 10, p), 3) for s in (0, 1, 2, 6, 10)] == [0.0, 0.5, 1.0, 0.5, 0.0]


def naive(data, params, vocab, steps_seen=None):
    """The same training in one plain loop over collected rows."""
    table = {}
    for r in data.where("y is not null").withColumn("b", F.expr(f"cast(pmod(xxhash64(doc_id, {params.seed}), "
                                                                f"{-(-data.where('y is not null').count() // params.batch_rows)}) as int)")).collect():
        table.setdefault(r.b, []).append((r.ids, r.y))
    w = {k: v.copy() for k, v in E.fresh_state(vocab, 3, params).weights.items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step, total = 0, len(table) * params.epochs
    for epoch in range(params.epochs):
        for b in np.random.default_rng((params.seed, epoch)).permutation(sorted(table)):
            g = {k: np.zeros_like(a) for k, a in w.items()}
            for ids, y in table[int(b)]:
                h = np.mean([w["embed"][i] for i in ids], axis=0) if ids else np.zeros(params.width)
                z = h @ w["out"] + w["bias"]
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                p[y] -= 1
                g["out"] += np.outer(h, p)
                g["bias"] += p
                for i in ids:
                    g["embed"][i] += w["out"] @ p / len(ids)
            g = {k: a / len(table[int(b)]) for k, a in g.items()}
            norm = np.sqrt(sum((a ** 2).sum() for a in g.values()))
            rate, step = E.rate_at(step, total, params), step + 1
            for k in w:
                a = g[k] * min(1.0, params.clip / (norm + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                w[k] = w[k] - (rate * params.weight_decay * w[k] if k != "bias" else 0) \
                    - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + params.eps)
    return w


def test_run_equals_a_plain_loop_and_resumes(spark):
    train, val = rows(spark), rows(spark, 40, 1)
    model, table, folder = E.train_epochs(train, val, 23, LABELS, PARAMS)
    last = E.written_epochs(spark, folder).orderBy(F.desc("epoch")).first()
    weights = E.State.unpacked(bytes(last["state"])).weights
    want = naive(train, PARAMS, 23)
    assert all(np.allclose(weights[k], want[k], atol=1e-9) for k in want)
    got = [tuple(r) for r in table.orderBy("epoch").select("epoch", "val_f1", "loss").collect()]
    assert [r[0] for r in got] == [0, 1, 2] and got[-1][2] < got[0][2]
    best = max(got, key=lambda r: (r[1], -r[0]))[0]
    kept = E.State.unpacked(bytes(E.written_epochs(spark, folder).where(F.col("epoch") == best).first()["state"])).weights
    assert all(np.array_equal(kept[k], model.weights[k]) for k in kept)
    # a run cut after its first epoch goes on to the same weights
    _, _, half = E.train_epochs(train, val, 23, LABELS, PARAMS, stop_after=1)
    again, table2, _ = E.train_epochs(train, val, 23, LABELS, PARAMS, half, resume=True)
    assert table2.count() == 3 and all(np.allclose(again.weights[k], model.weights[k], atol=1e-12) for k in model.weights)
    out = model.transform(val).collect()
    assert all(0 < r.confidence <= 1 and r.predicted_label == LABELS[r.prediction] for r in out) and len(out) == 40
    assert model.transform(val.limit(0)).count() == 0


def test_no_labelled_rows_are_an_error(spark):
    with pytest.raises(ValueError, match="no labelled rows"):
        E.train_epochs(rows(spark).where("y > 9"), rows(spark), 23, LABELS, PARAMS)
