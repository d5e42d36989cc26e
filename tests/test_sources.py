"""Sources and sinks (S01-S06), combine."""
import tempfile

import pytest
from pyspark.sql import functions as F

from topicflow.plans import prepare
from topicflow.sources import readers


def test_unknown_source_raises(spark):
    with pytest.raises(ValueError):
        readers.load_source(spark, "nope", "/x")


def test_optional_scan_all_missing_raises(spark):
    with pytest.raises(RuntimeError):
        readers.read_optional(spark, {"a": "/no/such/a", "b": "/no/such/b"}, lambda s, p: s.read.parquet(p))


def test_jsonl_corrupt_line_kept_aside(spark):
    d = tempfile.mkdtemp(prefix="tf-json-")
    with open(f"{d}/part.json", "w", encoding="utf-8") as f:
        f.write('{"text": "caf\\u00e9 ok", "label": "A"}\n{not json\n{"text": "b", "label": "B"}\n')
    rows = readers.social_posts(spark, d, rejects=f"{d}-rejects").orderBy("target").collect()
    assert [(r.text, r.target) for r in rows] == [("café ok", "A"), ("b", "B")]
    assert [r.line for r in spark.read.parquet(f"{d}-rejects").collect()] == ["{not json"]
    with pytest.raises(Exception, match="not a JSON line"):          # without a reject folder it is an error
        readers.social_posts(spark, d).collect()


def test_csv_multiline_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-") + "/out"
    df = spark.createDataFrame([(1, 'a "quoted"\nline', " t "), (2, "", None)], "doc_id long, text string, target string")
    readers.write_csv(df, d)
    back = {r.doc_id: (r.text, r.target) for r in readers.read_csv(spark, d).collect()}
    assert back[1] == ('a "quoted"\nline', " t ")
    assert back[2][1] is None


def test_combine_adds_domain(spark):
    a = spark.createDataFrame([("x", "t1")], "text string, target string")
    b = spark.createDataFrame([("y", "t2", 5)], "text string, target string, extra int")
    out = prepare.combine({"news": a, "social": b})
    assert sorted((r.domain, r.text) for r in out.collect()) == [("news", "x"), ("social", "y")]
