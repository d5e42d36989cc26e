"""Small Column helpers: edge cases against the reference's Python rules."""
from datetime import datetime, timezone

from pyspark.sql import functions as F

from topicflow.functions import text as T
from topicflow.operators import sample


def test_category_helpers(spark):
    df = spark.createDataFrame([(["cs.AI math.ST", "x"],), ([],), (["  hep-th  "],), (None,)], "cats array<string>")
    rows = df.select(T.first_category("cats").alias("f"), T.category_root("cats").alias("r")).collect()
    assert [(r.f, r.r) for r in rows] == [("cs.AI math.ST", "cs"), ("unknown", "unknown"),
                                          ("  hep-th  ", "hep-th"), ("unknown", "unknown")]


def test_primary_category_display_name_correct_flag(spark):
    df = spark.createDataFrame([("comp.sys.mac", "logistic_regression", "a", "a"),
                                ("sci", "transformer_lemmatized", "a", "b")], "t string, m string, y string, p string")
    rows = df.select(T.primary_category("t").alias("c"), T.display_name("m").alias("d"),
                     T.correct_flag("y", "p").alias("ok")).collect()
    assert [(r.c, r.d, r.ok) for r in rows] == [("comp", "Logistic Regression", True),
                                                ("sci", "Transformer Lemmatized", False)]


def test_post_text_arms(spark):
    df = spark.createDataFrame([("T", "body"), ("T", ""), (" T ", None), (None, None)], "title string, selftext string")
    with_title = [r.x for r in df.select(T.post_text("title", "selftext", True).alias("x")).collect()]
    body_first = [r.x for r in df.select(T.post_text("title", "selftext", False).alias("x")).collect()]
    py = [((t or "") + "\n\n" + (b or "")).strip() for t, b in [("T", "body"), ("T", ""), (" T ", None), (None, None)]]
    assert with_title == py
    assert body_first == ["body", "T", " T ", ""]


def test_iso_utc_matches_python(spark):
    vals = [0.0, 1700000000.0, 1700000000.25, 1710054000.0]
    rows = spark.createDataFrame([(v,) for v in vals], "t double").select("t", T.iso_utc("t").alias("s")).collect()
    for r in rows:
        assert r.s == datetime.fromtimestamp(r.t, timezone.utc).isoformat()


def test_first_rows_is_ordered_limit(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    rows = sample.first_rows(sample.seeded_order(df, "doc_id"), ["shuffle_key"], 5).collect()
    assert len(rows) == 5 and [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
