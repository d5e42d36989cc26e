"""Plan shape checks: built-in expressions only, partial
top-k before shuffles, pruned scans, pushed filters."""
import pytest

from topicflow.plans import catalog, prepare

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["balanced_topic_counts", "cleaning_audit", "tfidf_long", "metrics_by_domain",
                                  "posts_collect_topic", "encode_fixed", "softmax_argmax"])
def test_no_python_evaluation(spark, name):
    p = _plan(catalog.QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_quota_cascade_uses_group_limits(spark):
    """The listing's per-subreddit limit acts before the shuffle (what the
    cascade keeps is written, so the listing's plan is looked at)."""
    from topicflow.operators import collect
    from topicflow.sources import derive
    p = _plan(collect.list_posts(derive.posts(spark, SF), "top", 25, "all"))
    assert "WindowGroupLimit" in p


def test_scan_pruned_and_filter_pushed(spark):
    df = catalog.QUERIES["clean_light_documents"](spark, SF).where("doc_id < 10")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_vocabulary_join_is_broadcast(spark):
    p = _plan(catalog.QUERIES["tfidf_long"](spark, SF))
    assert "BroadcastHashJoin" in p       # vocabulary (<= max_features rows, counted) is broadcast


def test_prepared_splits_prune_partitions(spark):
    import tempfile

    from topicflow.plans import prepare
    from topicflow.sources import derive
    out = tempfile.mkdtemp(prefix="tf-splits-") + "/prepared"
    prepare.write_splits(prepare.prepare(derive.corpus(spark, SF), derive.derived_taxonomy(spark, SF)), out)
    df = prepare.read_split(spark, out, "tfidf", "train")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "(split#" in plan
    assert df.count() > 0 and df.select("clean_text").where("clean_text = ''").count() == 0


def test_spread_only_for_few_splits(spark):
    from topicflow.session import spread
    par = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, numPartitions=par * 2)
    assert spread(many, "id") is many                     # large inputs keep their splits
    few = spark.range(0, 1000, numPartitions=1)
    spread_plan = _plan(spread(few, "id"))
    assert "Exchange hashpartitioning(id" in spread_plan    # keyed, no round-robin sort


def test_light_text_is_cleaned_once_for_both_light_versions(spark):
    df = spark.createDataFrame([(1, "See http://x.y  the Children. ran!"), (2, None), (3, " \n\x1c")], "doc_id long, text string")
    v = prepare.cleaned_versions(df)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[URL]") == 1
    got = {(r.doc_id, r.version): r.clean_text for r in v.collect()}
    for name in prepare.VERSIONS:
        assert {r.doc_id: r.x for r in df.select("doc_id", prepare.version_text(name).alias("x")).collect()} == \
            {d: t for (d, n), t in got.items() if n == name}


def test_flagged_versions_give_the_audit_and_the_split_of_the_texts(spark):
    df = spark.createDataFrame([(i, "en", "the model ran." if i % 3 else " ") for i in range(30)], "doc_id long, domain string, text string")
    v = prepare.cleaned_versions(df)
    flagged = prepare.flagged_versions(v)
    assert "clean_text" not in flagged.columns
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(prepare.cleaning_audit(flagged)) == rows(prepare.cleaning_audit(v))
    assert rows(prepare.narrow_versions(flagged)) == rows(prepare.narrow_versions(v))
