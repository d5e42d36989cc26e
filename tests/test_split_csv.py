"""Parallel multi-line CSV scan (S01) against Python's csv module and against
Spark's one-task reader."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from topicflow.sources import readers, split_csv

SCHEMA = Ty.StructType([Ty.StructField("doc_id", Ty.LongType()), Ty.StructField("text", Ty.StringType()),
                        Ty.StructField("target", Ty.StringType())])
ODD = [(1, "plain", "a"), (2, "two\nlines", "b"), (3, 'he said "no"\n"yes"', "c,d"), (4, '"', '""'), (5, "\n\n", '"\n"'),
       (6, "é漢\n𝄞", None), (7, "x,\n,y", "z"), (8, "end\\", "e"), (9, 'a"\n', "f")]


def text_of(rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    w.writerow(["doc_id", "text", "target"])
    w.writerows([[v if v is not None else None for v in r] for r in rows])
    return out.getvalue()


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
    yield use
    for n, v in old.items():
        spark.conf.set(n, v)


def read(spark, path):
    return sorted(((r["doc_id"], r["text"], r["target"]) for r in split_csv.read_csv_split(spark, str(path), SCHEMA).collect()), key=repr)


def test_split_at_every_offset(spark, small_splits, tmp_path):
    """Headers of 16 lengths move the rows against splits of 16 bytes, so a
    split starts at every offset of the rows in one of the files."""
    rows = [(1, 'a\n"b"', "x\n\ny"), (22, '"', "z,\n")]
    data = text_of(rows)
    for k in range(16):
        (tmp_path / f"{k:02d}.csv").write_text(data.replace("target", "target" + "_" * k, 1), newline="")
    small_splits(16)
    assert read(spark, tmp_path) == sorted(rows * 16, key=repr)
    assert split_csv._lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 16 * (len(data) // 16)


@pytest.mark.parametrize("size, end", [(3, "\n"), (8, "\r\n"), (1 << 20, "\r\n")])
def test_odd_fields(spark, small_splits, tmp_path, size, end):
    (tmp_path / "f.csv").write_text(text_of(ODD, end), newline="")
    small_splits(size)
    assert read(spark, tmp_path) == sorted(ODD, key=repr)


def test_random_files(spark, small_splits, tmp_path):
    draw = random.Random(5)
    rows = [(k, "".join(draw.choice('ab "\n,') for _ in range(draw.randint(1, 30))) + "x", "t" * draw.randint(1, 3)) for k in range(120)]
    (tmp_path / "r.csv").write_text(text_of(rows), newline="")
    small_splits(197)
    assert read(spark, tmp_path / "r.csv") == sorted(rows, key=repr)


def test_empty_files_blank_records_and_bad_quotes(spark, tmp_path):
    (tmp_path / "e.csv").write_text("doc_id,text,target\n")
    assert read(spark, tmp_path / "e.csv") == []
    (tmp_path / "b.csv").write_text("doc_id,text,target\n\n1,a,b\n\n")
    assert read(spark, tmp_path / "b.csv") == [(1, "a", "b")]
    (tmp_path / "q.csv").write_text('doc_id,text,target\n1,"a,b\n')
    with pytest.raises(ValueError, match="do not balance"):
        read(spark, tmp_path / "q.csv")
    (tmp_path / "n.csv").write_text("doc_id,text,target\nx,a,b\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read(spark, tmp_path / "n.csv")


def test_equal_to_the_whole_file_reader(spark, small_splits, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("source").alias("target"))
    readers.write_csv(docs.coalesce(1), str(tmp_path / "one"))
    small_splits(32768)
    whole, split = readers.read_csv(spark, str(tmp_path / "one"), SCHEMA), split_csv.read_csv_split(spark, str(tmp_path / "one"), SCHEMA)
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0 and split.count() == docs.count()


def test_large_texts_are_written_as_several_files(spark, tmp_path, monkeypatch):
    """One task no longer writes the whole CSV file."""
    from topicflow.plans import catalog
    from topicflow.sources import readers
    rows = [(i, f'line {i}\n"quoted", {i}\n', "en", "src1", 10) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    files = []
    load = readers.load_source
    monkeypatch.setattr(readers, "load_source", lambda s, n, p: (files.extend(s.read.text(p).inputFiles()), load(s, n, p))[1])
    for limit in (1 << 10, 1 << 30):
        monkeypatch.setattr(catalog, "CSV_FILE_BYTES", limit)
        files.clear()
        got = sorted(map(tuple, catalog.q_csv_split_scan(spark, str(tmp_path)).collect()))
        assert got == [(i, t, s) for i, t, _, s, _ in rows]
        assert len(files) > 2 if limit == 1 << 10 else len(files) == 1
