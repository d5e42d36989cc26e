"""Classifier floor, search, registry, streaming scoring."""
import os
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from topicflow.operators import classify, search
from topicflow.plans import catalog
from topicflow.sources import registry
from topicflow.streaming import ingest

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lang_split(spark):
    return catalog._labelled_split(spark, SF001, "tfidf")


def test_logistic_floor(spark, lang_split):
    """Metric floor: language is clearly learnable."""
    train = lang_split.where(F.col("split") == "train")
    model = classify.train_classic(train, lr=classify.LogisticParams(max_iter=100))
    scored = classify.score(lang_split.where(F.col("split") != "train"), model, "logistic_regression")
    acc = scored.select(F.avg((F.col("label") == F.col("predicted_label")).cast("double"))).first()[0]
    assert acc >= 0.95
    assert scored.where(F.col("confidence") > 1.0 + 1e-9).count() == 0


def test_no_empty_class(spark, lang_split):
    """The model has exactly the training labels as classes; every one can be
    named, and a label unseen in training does not add one."""
    train = lang_split.where(F.col("split") == "train")
    k = train.select("label").distinct().count()
    model = classify.train_classic(train, lr=classify.LogisticParams(max_iter=20))
    lr = model.stages[-2]
    assert lr.numClasses == k and lr.interceptVector.size == k
    probe = train.limit(3).withColumn("label", F.lit("unseen"))
    assert all(len(r.p) == k for r in model.transform(probe).select(vector_to_array("probability").alias("p")).collect())
    dense = classify.train_dense(train, params=classify.DenseParams(vector_size=8, hidden=8, max_iter=3, min_count=5))
    assert dense.stages[-2].getLayers()[-1] == k


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_one_vs_rest_scores(spark, lang_split, penalty):
    train = lang_split.where(F.col("split") == "train")
    params = classify.LogisticParams(max_iter=15, penalty=penalty, one_vs_rest=True)
    model = classify.train_classic(train, lr=params)
    out = classify.score(lang_split.where(F.col("split") == "val"), model, "ovr")
    r = out.agg(F.avg((F.col("label") == F.col("predicted_label")).cast("double")).alias("acc"),
                F.min("confidence").alias("lo"), F.max("confidence").alias("hi")).first()
    assert r.acc >= 0.9 and 0.0 < r.lo <= r.hi <= 1.0


def test_search_points_deterministic_and_in_space(spark):
    a = search.search_points(spark, 20, seed=42).collect()
    b = search.search_points(spark, 20, seed=42).collect()
    assert a == b
    for r in a:
        p = dict(r.params)
        assert 1 <= int(p["ngram_min"]) <= int(p["ngram_max"]) <= 3
        assert 2 <= int(p["min_df"]) <= 10 and 0.5 <= float(p["max_df"]) <= 0.95
        assert 0.01 <= float(p["C"]) <= 10.0
        assert p["penalty"] == "l2" or p["solver"] == "liblinear"


def test_random_search_and_best(spark, lang_split):
    train = lang_split.where(F.col("split") == "train")
    val = lang_split.where(F.col("split") == "val")
    space = {**search.SPACE, "max_iter": ("cat", ["20"])}
    trials = search.random_search(train, val, n_trials=2, seed=3, space=space)
    rows = trials.collect()
    assert len(rows) == 2 and all(r.status == "ok" and r.params["max_iter"] == "20" for r in rows)
    none_left = {**space, "min_df": ("int", 10**6, 10**6)}
    failed = search.random_search(train, val, n_trials=1, seed=3, space=none_left).first()
    assert failed.status == "failed" and failed.val_f1 == 0.0 and failed.message
    best = search.best_trial(trials).first()
    assert best.val_f1 == max(r.val_f1 for r in rows)


def test_best_and_top_trials_ties_and_nulls(spark):
    t = spark.createDataFrame([(0, 0.5), (1, None), (2, 0.7), (3, 0.7), (4, 0.1), (5, 0.2), (6, 0.3)],
                              "trial int, val_f1 double")
    assert search.best_trial(t).first().trial == 2
    assert [r.trial for r in search.top_trials(t, 5).collect()] == [2, 3, 0, 6, 5]


def test_registry_latest(spark):
    root = tempfile.mkdtemp(prefix="tf-reg-", dir=os.environ.get("TMPDIR", "/tmp"))
    registry.log_run(spark, root, "e1", {"a": 1}, {"m": 0.5}, ["cleaned_data"], run_id="r1", start_time=1.0)
    registry.log_run(spark, root, "e2", {}, {}, ["cleaned_data"], run_id="r2", start_time=2.0)
    registry.log_run(spark, root, "e1", {}, {}, [], run_id="r3", start_time=3.0)
    latest = registry.latest_run_with_artifact(registry.runs(spark, root), "cleaned_data").first()
    assert latest.run_id == "r2"
    registry.register_version(spark, root, "clf", "/x/1")
    registry.register_version(spark, root, "clf", "/x/2")
    v = registry.latest_versions(spark.read.parquet(f"{root}/model_versions")).first()
    assert (v.version, v.uri) == (2, "/x/2")
    assert registry.load_model(spark, "/nonexistent", root, "nomodel") is None
    broken = f"{root}/broken"
    os.makedirs(broken)
    with pytest.raises(Exception):                      # a folder that holds no model is not "no model"
        registry.load_model(spark, broken)


def test_stream_scoring_with_rejects(spark, lang_split):
    train = lang_split.where(F.col("split") == "train")
    model = classify.train_classic(train, lr=classify.LogisticParams(max_iter=30))
    root = tempfile.mkdtemp(prefix="tf-score-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, "x" * 10001)], "doc_id long, text string")
    # no limit is set: a text over 10,000 characters is scored like any other
    docs.unionByName(extra).write.json(f"{root}/in/a")
    from topicflow.functions import tokens
    ingest.score_stream(spark, f"{root}/in/*/*.json", model, "logistic_regression", tokens.tfidf_text("text"),
                        f"{root}/out", f"{root}/rej", f"{root}/ckpt")
    out = spark.read.parquet(f"{root}/out")
    rej = spark.read.parquet(f"{root}/rej")
    assert out.count() == 1001 and out.where("doc_id = -2").count() == 1
    assert [(r.doc_id, r.reject_reason) for r in rej.select("doc_id", "reject_reason").collect()] == [(-1, "empty")]
    summ = spark.read.parquet(f"{root}/out_summary").agg(F.sum("n_rows"), F.sum("n_rejected")).first()
    assert tuple(summ) == (1002, 1)
    limited = ingest.validate(extra, max_chars=10_000).orderBy("doc_id").collect()
    assert [r.reject_reason for r in limited] == ["too_long", "empty"]


def test_model_save_load_roundtrip(spark, lang_split):
    train = lang_split.where(F.col("split") == "train")
    model = classify.train_classic(train, lr=classify.LogisticParams(max_iter=20))
    path = tempfile.mkdtemp(prefix="tf-model-") + "/m"
    registry.save_model(model, path)
    loaded = registry.load_model(spark, path)
    val = lang_split.where(F.col("split") == "val")
    a = classify.score(val, model, "m").select("doc_id", "predicted_label").orderBy("doc_id").collect()
    b = classify.score(val, loaded, "m").select("doc_id", "predicted_label").orderBy("doc_id").collect()
    assert a == b


def test_learning_curve_shape(spark, lang_split):
    from topicflow.operators import curves
    train = lang_split.where(F.col("split") == "train")
    val = lang_split.where(F.col("split") == "val")

    def majority(part, ev):
        top = part.groupBy("label").count().orderBy(F.desc("count"), "label").first().label
        return ev.select("doc_id", F.col("label").alias("y"), F.lit(top).alias("p"))

    curve = curves.learning_curve(train, val, majority, "majority")
    rows = sorted(curve.collect(), key=lambda r: r.pct)
    assert [r.pct for r in rows] == [25, 50, 75, 100]
    assert all(0.0 <= r.accuracy <= 1.0 for r in rows)
    assert curves.improvement_rates(curve).count() == 3


def test_render_report(spark):
    from topicflow.operators import metrics
    from topicflow.sources import derive
    text = metrics.render_report(metrics.classification_report(derive.predictions(spark, SF001)), digits=2)
    assert "macro avg" in text and "micro avg" in text and "precision" in text


def test_log_preparation_run(spark):
    from topicflow.plans import prepare
    from topicflow.sources import derive
    root = tempfile.mkdtemp(prefix="tf-prep-")
    corpus = derive.corpus(spark, "/root/testdata/sf0.001")
    versions = prepare.cleaned_versions(corpus)
    rid = prepare.log_preparation(spark, root, versions, prepare.split_versions(versions))
    m = {r.key: r.value for r in spark.read.parquet(f"{root}/run_metrics").where(F.col("run_id") == rid).collect()}
    assert m["tfidf_train_count"] + m["tfidf_val_count"] + m["tfidf_test_count"] == m["tfidf_documents_count"]
    latest = registry.latest_run_with_artifact(registry.runs(spark, root), "cleaned_data").first()
    assert latest.run_id == rid


def test_writers_that_register_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    root = str(tmp_path / "r")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: registry.register_version(spark, root, "m", f"u{k}"), range(8)))
    assert sorted(got) == list(range(1, 9)) and registry.register_version(spark, root, "other", "u") == 1
    rows = spark.read.schema(registry.VERSIONS_SCHEMA).parquet(f"{root}/model_versions")
    assert sorted(r.version for r in rows.where("model = 'm'").collect()) == list(range(1, 9))
