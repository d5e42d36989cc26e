"""Pairwise quality ranking: features, loss, thresholds, held-out labels."""
import numpy as np
import pyarrow as pa
import pytest

from topicflow.llm import quality as Q

DOCS = "doc_id long, text string, lang string, score double, held_out boolean, body string, y int, x string"


def named(text):
    return dict(zip(Q.FEATURES, Q.describe(pa.array(["other words", text]))[1]))


def test_features_by_hand():
    f = named("AB cd! cd! %\nAB cd! cd! %")
    assert f["upper"] == 4 / 12 and f["exclaims"] == 4 / 25 and f["signs"] == 2 / 25
    assert f["distinct_words"] == 3 / 8 and f["top_word"] == 4 / 8 and f["same_again"] == 2 / 8
    assert f["distinct_pairs"] == pytest.approx(4 / 7) and f["bare_signs"] == 2 / 8 and f["sign_ends"] == 2 / 8
    assert f["upper_words"] == 2 / 8 and f["repeated_lines"] == 1 / 2 and f["log_words"] == pytest.approx(np.log(9))


def test_empty_long_and_odd_texts():
    x = Q.describe(pa.array([None, "", "   \n ", "a", "é漢𝄞", "word " * 50000, "x" * 300000]))
    assert x.shape == (7, len(Q.FEATURES)) and np.isfinite(x).all()
    assert (x[0] == 0).all() and (x[1] == 0).all()
    assert Q.describe(pa.array([], pa.string())).shape == (0, len(Q.FEATURES))


def test_features_do_not_depend_on_the_batch():
    texts = ["one two two", None, "A B\nA B", "%%% x", "déjà vu déjà"]
    whole = Q.describe(pa.array(texts))
    assert np.array_equal(whole, np.vstack([Q.describe(pa.array([t], pa.string())) for t in texts]))
    assert np.array_equal(whole[2:4], Q.describe(pa.array(texts).slice(2, 2)))


def test_pairs_hold_every_row():
    y = np.array([1] * 30 + [0] * 7)
    win, lose = Q.draw_pairs(y, 1000)
    assert (y[win] == 1).all() and (y[lose] == 0).all()
    assert set(win) == set(range(30)) and set(lose) == set(range(30, 37)) and len(win) <= 1000


def test_newton_finds_the_minimum():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 4))
    y = (x @ [1.0, -2.0, 0.0, 0.5] + draw.logistic(size=400) > 0).astype(int)
    w = Q.fit_strengths(x, y, 4000)
    win, lose = Q.draw_pairs(y, 4000)
    d = x[win] - x[lose]

    def loss(v):
        return np.logaddexp(0, -(d @ v)).mean() + Q.RIDGE / 2 * v @ v
    gradient = [(loss(w + e) - loss(w - e)) / 2e-5 for e in 1e-5 * np.eye(4)]
    assert np.abs(gradient).max() < 1e-6
    assert all(loss(w) <= loss(w + 0.05 * draw.normal(size=4)) for _ in range(20))


def test_quantile_level_parts_the_labels():
    score = np.array([0.0, 1.0, 2.0, 2.0, 3.0, 9.0])
    assert Q.level_of(score, np.array([0, 0, 0, 0, 1, 1])) == pytest.approx(4 / 6)
    assert Q.level_of(score, np.array([0, 1, 1, 1, 1, 1])) == pytest.approx(1 / 6)
    best = Q.level_of(score, np.array([0, 0, 1, 0, 1, 1]))      # the tie can't be parted
    assert round(best * 6) in (2, 4)


def test_threshold_is_the_quantile():
    draw = np.random.default_rng(4)
    y = np.array([0] * 50 + [1] * 200)
    x = draw.normal(size=(250, 3)) + y[:, None] * [3.0, 0, 0]
    r = Q.Ranking(x, y)
    p = r.score(x)
    assert ((p >= Q.THRESHOLD) == (r.standard(x) @ r.weights >= r.at)).mean() > 0.999
    assert ((p >= Q.THRESHOLD) == (y == 1)).mean() > 0.9 and p.min() >= 0 and p.max() <= 1


def frames(spark, n=160):
    plain = "the river and the old stone bridge under a green hill where people walk after rain"
    words = plain.split()
    rows = [(k, " ".join(words[(k * 3 + j * (1 + k % 4)) % len(words)] + ("" if k % 2 else "%%%") for j in range(20 + k % 9)),
             "en", 0.1, True, "b", 1, "x") for k in range(n)]
    rows += [(None, plain, "en", 0.1, True, "b", 1, "x"), (7, None, "en", 0.1, True, "b", 1, "x"), (8, "", "en", 0.1, True, "b", 1, "x"),
             (9, plain * 2000, "en", 0.1, True, "b", 1, "x"), (9, plain * 2000, "en", 0.1, True, "b", 1, "x")]
    labels = [(k, k % 2, 0) for k in range(0, n)] + [(3, None, 0), (None, 1, 0), (10 ** 9, 0, 0), (5, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_of_all_rows(spark):
    import zlib
    docs, labels = frames(spark)
    got = Q.scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    only = [r for r in got if r["doc_id"] is not None and r["doc_id"] not in (7, 8, 9)]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in only]) > 0.97


def test_one_kind_of_label_or_none(spark):
    docs, labels = frames(spark)
    assert {r["score"] for r in Q.scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in Q.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert Q.scores(docs.limit(0), labels).count() == 0


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op13_pairwise_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id") \
        .where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.95


def test_model_counts_every_labelled_row(spark, monkeypatch):
    """20,400 labelled rows, few of label 0: all are counted, over many blocks."""
    import zlib
    from pyspark.sql import functions as F
    bad, n = 300, 25_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(
        f"concat('the old bridge ', repeat('and hill ', cast(id % 9 as int)), cast(id % 5000 as string), if(id < {bad}, ' %%% @@ %%', ' road'))").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= bad).cast("int").alias("quality"))
    seen, place = [], Q.Ranking.place
    monkeypatch.setattr(Q.Ranking, "place", lambda self, aside, y, count: (seen.append((y, count)), place(self, aside, y, count))[1])
    got = Q.scores(docs, labels).toPandas()
    fitted = [k for k in range(n) if zlib.crc32(str(k).encode()) % 5]
    y, count = seen[0]
    assert count.sum() == len(fitted) > 20_000 and count[y == 0].sum() == sum(k < bad for k in fitted)
    assert (got.predicted == (got.doc_id >= bad)).mean() > 0.99


def test_blocks_hold_both_labels(spark):
    from pyspark.sql import functions as F
    from topicflow.llm import common as C
    rows = spark.range(1000).select("id", (F.col("id") < 30).cast("long").alias("y"))
    got = C.deal(rows, F.col("y"), F.xxhash64("id"), {0: 970, 1: 30}, 50, 10).toPandas()
    assert (got[got.y == 0].groupby("id").size() == 1).all() and set(got.id) == set(range(1000)) and set(got.block) == set(range(20))
    assert (got[got.y == 1].groupby("id").block.nunique() == 7).all() and got[got.y == 1].groupby("block").size().min() >= 3


def test_steps_of_blocks_are_those_of_arrays(spark):
    """One block: the jobs find the minimum that arrays give."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(200, len(Q.FEATURES)))
    y = (x[:, 0] - x[:, 1] + draw.logistic(size=200) > 0).astype(int)
    model = Q.Ranking.of(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rows = [{"h": k, "y": int(y[k]), "n": 1, "fold": k % 5, "x": x[k].tolist()} for k in range(200)]
    blocks = spark.createDataFrame([(rows,)], "rows array<struct<h:long,y:long,n:long,fold:long,x:array<double>>>")
    got = Q.fit_blocks(blocks, model)
    want = Q.fit_strengths(x, y, Q.PER_ROW * max(y.sum(), 200 - y.sum()))
    assert len(got) == 6 and np.abs(got[5] - want).max() < 1e-5
