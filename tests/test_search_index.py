"""Inverted index against the plain listing match."""
import random

import pytest
from pyspark.sql import functions as F

from topicflow.operators import collect, search_index as S


def posts(spark, n=700, first=0, seed=3):
    draw = random.Random(seed)
    words = "the other theatre stone River été 漢字 a_b x1 the-end o'clock".split()
    rows = [(str(first + i), i % 2, draw.choice([None, "", " ".join(draw.choices(words, k=4))]),
             draw.choice([None, "", "common " + " ".join(draw.choices(words, k=6))])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, copy int, title string, selftext string")


def ids(df):
    return sorted((r["id"], r["copy"]) for r in df.select("id", "copy").collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    a, b = posts(spark).repartition(3), posts(spark, 300, 700, 4)
    S.append(a, folder, ["id", "copy"])
    S.append(b, folder, ["id", "copy"])
    return folder, a.unionByName(b).persist()


@pytest.mark.parametrize("query", ["the", "river", "Common", "stone the", "the-end", "éT", "漢", "x1 common", "_", "zzz", "the the"])
def test_equals_the_plain_match(spark, index, query):
    folder, every = index
    got = S.search(spark, folder, query, every, ["id", "copy"])
    assert ids(got) == ids(every.where(collect.matches(query)))


def test_scan_is_pruned_and_blocks_are_bounded(spark, index):
    folder, every = index
    plan = S.find(spark, folder, "river")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    rows = spark.read.parquet(f"{folder}/postings")
    assert rows.agg(F.max("n")).first()[0] <= 1 << S.BLOCK_BITS
    assert rows.where("term = 'common'").count() > 1 and rows.select("batch").distinct().count() == 2


def test_appending_reads_no_old_text(spark, index, tmp_path):
    """The tables of a batch depend on its posts alone: the second batch equals
    an index of these posts, but for its numbers."""
    folder, every = index
    fresh = str(tmp_path / "f")
    S.append(posts(spark, 300, 700, 4), fresh, ["id", "copy"])
    cols = ["term", "n"]
    old = spark.read.parquet(f"{folder}/postings").where("batch = 1").groupBy("term").agg(F.sum("n").alias("n"))
    new = spark.read.parquet(f"{fresh}/postings").groupBy("term").agg(F.sum("n").alias("n"))
    assert old.select(cols).exceptAll(new.select(cols)).count() == 0 and new.select(cols).exceptAll(old.select(cols)).count() == 0
    with pytest.raises(ValueError, match="needs a word"):
        S.find(spark, folder, "...")
    with pytest.raises(ValueError, match="verified"):
        S.search(spark, folder, "two words")
