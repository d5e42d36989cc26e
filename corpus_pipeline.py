"""Corpus pipeline over ``documents``: reject toxic texts, drop exact copies,
keep one document of each near-duplicate group, mix the sources to their target
weights, pack token sequences. Each stage works on all that its predecessor
kept and is written before the next one reads it; all but the last return the
columns of ``documents``.

Edge cases: the stages take the operators' rules for nulls, empty and long
texts, and pass other columns on whatever their names. Rows that repeat both
doc_id and text (after white-space normalisation) leave one row in the exact
stage, the first by text and then by a hash of the row; the near-duplicate stage takes rows by doc_id
and text, so rows that share a doc_id are judged each, and one row of a group
of null doc_ids stays if nothing with a doc_id is in it. An empty table gives
an empty result.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from topicflow.llm import common as C
from topicflow.llm import exact_dedup, mixing, packing, parity_join, toxicity


def reject_toxic(spark, docs, sf_dir):
    return toxicity.clean_documents(docs, C.read(spark, sf_dir, "labels"))


def unused(name, docs):
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_copies(spark, docs, sf_dir):
    sha, keep_id, keep_sha = (unused(n, docs) for n in ("sha", "keep_id", "keep_sha"))
    keep = (exact_dedup.exact_groups(docs).where("kept")
            .select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha)).distinct())
    mine = docs.withColumn(sha, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    found = mine.join(keep, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # of rows that share id and text one stays, always the same one
    one = found.groupBy(keep_id, keep_sha).agg(F.min_by(row, F.struct("text", F.sha2(F.to_json(row), 256))).alias(keep_id + "_row"))
    return one.select(*[F.col(f"{keep_id}_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark, docs, sf_dir):
    row = unused("row", docs)
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    groups = parity_join.jaccard_components(keyed, id_col=row).select(F.col("doc_id").alias(row), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row))
    keep = (keyed.select("doc_id", row).distinct().join(groups, row).groupBy("component_id").agg(first.alias("first"))
            .select(F.col(f"first.{row}").alias(row)))
    return keyed.join(keep, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack_documents(docs)


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
