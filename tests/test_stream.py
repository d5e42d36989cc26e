"""R01 streaming ingest: each post id once, labelled and serialized."""
from pyspark.sql import functions as F

from topicflow.functions import text as T
from topicflow.plans import catalog
from topicflow.sources import derive
from topicflow.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_stream_ingest_dedups_across_files(spark):
    out = catalog.QUERIES["stream_ingest_posts"](spark, SF)
    rows = out.select("id", "label", "created_utc").collect()
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids))
    expected = derive.posts(spark, SF).where((F.col("copy") == 0) & T.has_text("title", "selftext")).count()
    assert len(ids) == expected
    assert all(r.label for r in rows) and all(r.created_utc.endswith("+00:00") for r in rows)


def test_bad_lines_and_old_posts(spark, tmp_path):
    """A line that is no JSON goes to the reject sink; a post decades older
    than the newest is kept; ids of earlier runs are not written again."""
    import json

    from topicflow.streaming import ingest

    def post(i, created):
        return json.dumps({"id": i, "title": "t", "selftext": "", "subreddit": "s", "created_utc": created,
                           "permalink": f"/{i}"})
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join([post("new", 2e9), post("old", 1e8), "{broken", post("new", 2e9)]) + "\n")
    args = (f"{src}/*.json", f"{tmp_path}/out", f"{tmp_path}/ckpt", None)
    ingest.ingest_posts(spark, *args)
    (src / "b.json").write_text("\n".join([post("old", 1e8), post("older", 1e7)]) + "\n")
    ingest.ingest_posts(spark, *args)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["new", "old", "older"]
    assert [r.line for r in spark.read.parquet(f"{tmp_path}/out_rejects").collect()] == ["{broken"]


def test_work_of_a_batch_depends_on_its_own_rows(spark, tmp_path):
    """Twenty batches, each repeating every id of the batch before: a batch
    reads its own rows, updates state for its new ids only, and never reads
    the sink; a copy of the input replayed later adds nothing."""
    import json

    from topicflow.streaming import ingest

    def post(i, k):
        return json.dumps({"id": str(i), "title": f"t{k}", "selftext": "", "subreddit": "s", "created_utc": float(k), "permalink": f"/{i}"})
    src = tmp_path / "in"
    src.mkdir()
    n = 20
    for k in range(n):
        (src / f"{k:02d}.json").write_text("\n".join(post(i, k) for i in range(10 * k, 10 * k + 20)) + "\n")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        args = (f"{src}/*.json", f"{tmp_path}/out", f"{tmp_path}/ckpt", None)
        q = ingest.ingest_posts(spark, *args, files_per_trigger=1)
        progress = [p for p in q.recentProgress if p["numInputRows"]]
        assert [p["numInputRows"] for p in progress] == [20] * n
        assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [20] + [10] * (n - 1)
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        assert sorted(int(r.id) for r in rows) == list(range(10 * n + 10))
        for k in range(3):
            (src / f"again{k}.json").write_text((src / f"{k:02d}.json").read_text())
        ingest.ingest_posts(spark, *args)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 10 * n + 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_first_of_a_batch_is_chosen_by_time(spark, tmp_path):
    import json

    from topicflow.streaming import ingest
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"id": "x", "title": t, "created_utc": c, "subreddit": "s", "score": 3}) for t, c in (("b", 5.0), ("a", 2.0), ("c", 9.0))]
    (src / "a.json").write_text("\n".join([*lines, "oops", "oops", json.dumps({"id": "empty", "title": "", "selftext": ""})]) + "\n")
    ingest.ingest_posts(spark, f"{src}/*.json", f"{tmp_path}/out", f"{tmp_path}/ckpt", None)
    assert [(r.id, r.text.strip()) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("x", "a")]
    assert [r.line for r in spark.read.parquet(f"{tmp_path}/out_rejects").collect()] == ["oops", "oops"]


def test_first_seen_sorts_only_ids_that_repeat(monkeypatch):
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.exists = True
    row = lambda t, p: pd.DataFrame({"created_utc": [t], "tie": ["x"], "payload": [p]})
    both = pd.concat([row(2.0, "late"), row(1.0, "early")])
    seen = State()
    assert [x.payload.tolist() for x in ingest.first_seen(("#a",), [both, row(0.5, "first")], seen)] == [["first"]]
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    assert list(ingest.first_seen(("#a",), [both, row(0.1, "again")], seen)) == []
    assert [x.payload.tolist() for x in ingest.first_seen(("#b",), [row(3.0, "only")], State())] == [["only"]]
