"""The README workflow, end to end on files derived from the driver tables."""
import tempfile

from pyspark.sql import functions as F

from topicflow.operators import classify, metrics, taxonomy
from topicflow.plans import prepare
from topicflow.sources import readers, registry

SF = "/root/testdata/sf0.001"


def test_readme_workflow(spark):
    root = tempfile.mkdtemp(prefix="tf-flow-")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    paths = {}
    for domain, lang in (("news", "en"), ("social", "de"), ("academic", "fr")):
        paths[domain] = f"{root}/{domain}"
        docs.where(F.col("lang") == lang).select("doc_id", "text", F.col("source").alias("target")) \
            .write.parquet(paths[domain])
    paths["missing"] = f"{root}/nope"
    corpus = readers.read_optional(spark, paths, lambda s, p: readers.load_source(s, "parquet", p))
    corpus = corpus.withColumnRenamed("target", "raw_target")
    maps = {d: {f"src{k}": f"T{k % 4}" for k in range(20)} for d in ("news", "social", "academic")}
    tax = taxonomy.taxonomy_from_dicts(spark, maps)
    taxonomy.assert_taxonomy_closed(tax, taxonomy.topics_frame(spark, [f"T{k}" for k in range(4)]))
    prepared = prepare.prepare(corpus, tax)
    out = f"{root}/prepared"
    prepare.write_splits(prepared, out)
    train = (prepare.read_split(spark, out, "tfidf", "train")
             .withColumnRenamed("clean_text", "text").withColumnRenamed("topic", "label"))
    test = (prepare.read_split(spark, out, "tfidf", "test")
            .withColumnRenamed("clean_text", "text").withColumnRenamed("topic", "label"))
    model = classify.train_classic(train, lr=classify.LogisticParams(max_iter=20))
    registry.save_model(model, f"{root}/model")
    preds = classify.score(test, registry.load_model(spark, f"{root}/model"), "lr") \
        .select(F.col("label").alias("y"), F.col("predicted_label").alias("p"))
    report = {r.label: r for r in metrics.classification_report(preds, labels="present").collect()}
    assert "macro avg" in report and report["macro avg"].support == test.count()
    # balanced: every domain has the same number of documents per version before filtering
    sizes = {r.domain: r.n for r in prepared.where(F.col("version") == "transformer")
             .groupBy("domain").agg(F.count("*").alias("n")).collect()}
    assert len(set(sizes.values())) == 1 and set(sizes) == {"news", "social", "academic"}
