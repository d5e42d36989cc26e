"""Exact seeded sampling and splits: properties (FIXTURES §4)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from topicflow.operators import sample


def test_split_sizes_formula():
    for n in range(1, 201):
        hold = (3 * n + 9) // 10
        test = (hold + 1) // 2
        import math
        assert hold == math.ceil(0.3 * n - 1e-9)
        assert test == math.ceil(hold / 2)
        assert (n - hold) + (hold - test) + test == n


def test_stratified_split_complete_and_exact(spark):
    rows = [(i, f"g{i % 7}") for i in range(700)] + [(1000 + i, "small") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, domain string")
    out = sample.stratified_split(df, by="domain", with_rank=True)
    assert out.count() == len(rows)
    assert out.select("doc_id").distinct().count() == len(rows)
    c = {(r.domain, r.split): r.n for r in out.groupBy("domain", "split").agg(F.count("*").alias("n")).collect()}
    for g in [f"g{k}" for k in range(7)]:
        n = 100
        hold = (3 * n + 9) // 10
        test = (hold + 1) // 2
        assert c[(g, "train")] == n - hold and c[(g, "val")] == hold - test and c[(g, "test")] == test
    assert c[("small", "train")] == 2 and c.get(("small", "val"), 0) == 0 and c[("small", "test")] == 1


def test_rank_equals_brute_force_and_is_partition_invariant(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("domain"))
    w = Window.partitionBy("domain").orderBy(sample.rank_key("doc_id"), "doc_id")
    brute = {r.doc_id: r.rank for r in base.withColumn("rank", F.row_number().over(w)).collect()}
    for parts in (1, 4, 64):
        got = {r.doc_id: r.rank for r in sample.exact_rank(base.repartition(parts), ["domain"]).collect()}
        assert got == brute


def test_balanced_sample_equal_sizes(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("domain"))
    b = sample.balanced_sample(base)
    sizes = {r.domain: r.n for r in b.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {106}


def test_nested_size_samples(spark):
    base = spark.range(0, 997).select(F.col("id").alias("doc_id"))
    s = sample.nested_size_samples(base)
    by = {p: {r.doc_id for r in s.where(F.col("pct") == p).collect()} for p in (25, 50, 75, 100)}
    assert len(by[100]) == 997 and len(by[25]) == round(0.25 * 997)
    assert by[25] <= by[50] <= by[75] <= by[100]


def test_fraction_sample_half_even(spark):
    base = spark.range(0, 10).select(F.col("id").alias("doc_id"))
    assert sample.fraction_sample(base, 0.25).count() == 2      # round(2.5) = 2
    assert sample.fraction_sample(base, 0.75).count() == 8      # round(7.5) = 8


def test_cut_keys_choose_the_ranked_rows(spark):
    """Samples and splits by cut keys hold exactly the rows that ranks give,
    also for strata of one or two rows."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("case when id < 3 then concat('t', id % 2) else concat('d', id % 3) end").alias("domain"))

    def rows(x, *cols):
        return sorted(tuple(r) for r in x.select(*cols).collect())
    assert rows(sample.stratified_split(df), "doc_id", "split") == rows(sample.stratified_split(df, with_rank=True), "doc_id", "split")
    assert rows(sample.balanced_rows(df), "doc_id") == rows(sample.balanced_sample(df), "doc_id")
    assert rows(sample.size_shares(df), "doc_id", "pct") == rows(sample.nested_size_samples(df), "doc_id", "pct")
    assert sample.stratified_split(df.limit(0)).count() == 0 and sample.balanced_rows(df.limit(0)).count() == 0


def test_splits_shuffle_no_text(spark):
    """No exchange of the preparation chain or a labelled split carries a text."""
    import re
    from topicflow.plans import catalog, prepare
    from topicflow.sources import derive
    sf = "/root/testdata/sf0.001"
    for q in (prepare.prepare(derive.corpus(spark, sf), derive.derived_taxonomy(spark, sf)), catalog._labelled_split(spark, sf)):
        q.collect()
        plan = q._jdf.queryExecution().executedPlan().toString()
        moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert not any("text" in m for m in moved) and "SortMergeJoin" not in plan
