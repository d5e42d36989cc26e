"""Corpus preparation: combine -> balance -> map -> clean x3 ->
filter -> split, as one lazy DataFrame chain.

Shuffles: the W00 bucket counts (narrow, partially aggregated) and the keys of
the buckets that hold a cut. Texts are never shuffled, and cleaned after
sampling so only kept rows pay for the regexes.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, tokens
from ..operators import sample, taxonomy
from ..operators.common import materialize

VERSIONS = ("tfidf", "transformer", "transformer_lem")
LIGHT_VERSIONS = {"transformer", "transformer_lem"}


def combine(dfs: Mapping[str, DataFrame]) -> DataFrame:
    """P01 + U01: add the constant domain per source and union by name."""
    out = None
    for domain, df in dfs.items():
        d = df.withColumn("domain", F.lit(domain))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise RuntimeError("No domain inputs given.")
    return out


def version_text(version: str, text="text", stops=tokens.STOP_WORDS_EN,
                 lemmas=tokens.LEMMAS_EN) -> F.Column:
    """The cleaned text of one version."""
    if version == "tfidf":
        return tokens.tfidf_text(text, stops, lemmas)
    if version == "transformer":
        return clean.clean_light(text)
    if version == "transformer_lem":
        return tokens.light_lemma_text(text, stops, lemmas)
    raise ValueError(f"Unknown version: {version}")


def cleaned_versions(df: DataFrame, versions=VERSIONS, text: str = "text") -> DataFrame:
    """One row per (document, version) with the cleaned text; the three
    versions come from one scan (array of structs, exploded). Where two of them
    begin with the light text it is a column of its own, cleaned once."""
    base, texts = df, {v: version_text(v, text) for v in versions if v not in LIGHT_VERSIONS or not LIGHT_VERSIONS <= set(versions)}
    if LIGHT_VERSIONS <= set(versions):
        base = df.withColumn("_tf_light", clean.clean_light(text))
        texts |= {"transformer": F.col("_tf_light"), "transformer_lem": tokens.light_lemmas("_tf_light")}
    arr = F.array(*[F.struct(F.lit(v).alias("version"), texts[v].alias("clean_text")) for v in versions])
    # explode_outer: no inferred size() filter re-running the cleaning
    return base.withColumn("_v", F.explode_outer(arr)).select(
        *[c for c in df.columns if c != text], "_v.version", "_v.clean_text")


def cleaning_audit(versions_df: DataFrame) -> DataFrame:
    """Per version kept, filtered, retention rate; of texts or of
    :func:`flagged_versions`."""
    fine = F.col("kept") if "kept" in versions_df.columns else clean.is_nonempty("clean_text")
    kept = F.sum(F.when(fine, 1).otherwise(0)).cast("bigint")
    total = F.count(F.lit(1))
    return (versions_df.groupBy("version")
            .agg(total.alias("n_docs"), kept.alias("n_kept"))
            .withColumn("n_filtered", F.col("n_docs") - F.col("n_kept"))
            .withColumn("retention", F.round(F.col("n_kept") / F.col("n_docs"), 6)))


def split_versions(versions_df: DataFrame, by: str = "domain", id_col: str = "doc_id",
                   seed: int = 42, with_rank: bool = False) -> DataFrame:
    """P05 + W03 per version: every version is filtered and split on its own,
    as the reference does; the key-based rank keeps a document on nearly the
    same side in all versions. The cleaned rows are read twice (bucket counts,
    then labels), so they are written once first; the texts are not shuffled.
    ``with_rank`` is for narrow rows (see :func:`narrow_versions`)."""
    kept = versions_df.where(clean.is_nonempty("clean_text")) if "clean_text" in versions_df.columns else versions_df
    return sample.stratified_split(materialize(kept, "versions"), ["version", by], id_col, seed, with_rank)


def flagged_versions(versions_df: DataFrame) -> DataFrame:
    """P05 as a column ``kept``, and the length in place of the text: what the
    audit and the split of the same versions both start from, so that one
    written table spares them a second cleaning."""
    return (versions_df.withColumn("kept", clean.is_nonempty("clean_text"))
            .withColumn("clean_chars", F.length("clean_text")).drop("clean_text"))


def narrow_versions(versions_df: DataFrame) -> DataFrame:
    """P05, then the length in place of the text: enough for ranks and audits."""
    if "kept" in versions_df.columns:
        return versions_df.where("kept").drop("kept")
    return (versions_df.where(clean.is_nonempty("clean_text"))
            .withColumn("clean_chars", F.length("clean_text")).drop("clean_text"))


def split_audit(splits: DataFrame) -> DataFrame:
    """Counts per version and split, ratio string ``a:b:c`` and shares."""
    c = splits.groupBy("version").agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("bigint").alias("n_train"),
        F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).cast("bigint").alias("n_val"),
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).cast("bigint").alias("n_test"))
    n = F.col("n_train") + F.col("n_val") + F.col("n_test")
    return c.select(
        "version", "n_train", "n_val", "n_test",
        F.concat_ws(":", F.col("n_train").cast("string"), F.col("n_val").cast("string"),
                    F.col("n_test").cast("string")).alias("ratio"),
        F.round(F.col("n_train") / n, 6).alias("train_pct"),
        F.round(F.col("n_val") / n, 6).alias("val_pct"),
        F.round(F.col("n_test") / n, 6).alias("test_pct"))


def balanced_topic_counts(corpus: DataFrame, tax: DataFrame) -> DataFrame:
    """Flagship: how many usable documents per topic in a balanced corpus?

    corpus -> W01 balanced sample by domain -> P03 topic map -> X12 light
    clean -> P05 -> counts per (domain, topic) with retention."""
    bal = sample.balanced_rows(corpus, by="domain")
    mapped = taxonomy.map_topics(bal, tax)
    kept = clean.is_nonempty(clean.clean_light("text"))
    return (mapped.groupBy("domain", "topic")
            .agg(F.count(F.lit(1)).alias("n_sampled"),
                 F.sum(F.when(kept, 1).otherwise(0)).cast("bigint").alias("n_kept"))
            .withColumn("retention", F.round(F.col("n_kept") / F.col("n_sampled"), 6)))


def prepare(corpus: DataFrame, tax: DataFrame, versions=VERSIONS, texts: bool = True) -> DataFrame:
    """The whole §3.1 chain: balanced, mapped, cleaned x3, filtered, split.
    Columns: doc_id, domain, raw_target, topic, version, clean_text, split; no
    text is shuffled. Without ``texts``: clean_chars in place of the text, and
    the rank that the split was cut from."""
    mapped = taxonomy.map_topics(sample.balanced_rows(corpus, by="domain"), tax)
    v = cleaned_versions(mapped, versions)
    return split_versions(v) if texts else split_versions(narrow_versions(v), with_rank=True)


def write_splits(prepared: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S04 for the processed corpus: Parquet partitioned by version and split
    (the reference wrote nine CSV files), so readers prune to one of them."""
    prepared.write.mode(mode).partitionBy("version", "split").parquet(path)


def read_split(spark, path: str, version: str, split: str) -> DataFrame:
    """Read one (version, split) of the processed corpus; the filters become
    partition filters, so other versions and splits are never listed or read."""
    return (spark.read.parquet(path)
            .where((F.col("version") == version) & (F.col("split") == split)))


PREPARATION_PARAMS = {
    "min_token_length": 3, "remove_stop_words": True, "lemmatization": True, "three_cleaning_versions": True,
    "train_size": 0.7, "val_size": 0.15, "test_size": 0.15, "stratify_by_domain": True, "random_state": 42,
}


def log_preparation(spark, root: str, versions_df: DataFrame, splits: DataFrame,
                    experiment: str = "preparation", artifact: str = "cleaned_data") -> str:
    """S15 for the preparation run: parameters plus the G04/G05 audit values
    (kept / filtered / retention per version, split counts and shares) as run
    metrics. The audits are a few rows per version; only they reach the
    driver."""
    from ..sources import registry
    metrics: dict[str, float] = {}
    for r in cleaning_audit(versions_df).collect():
        metrics[f"{r.version}_documents_count"] = r.n_kept
        metrics[f"{r.version}_documents_filtered"] = r.n_filtered
        metrics[f"final_{r.version}_retention_rate"] = r.retention
    params = dict(PREPARATION_PARAMS)
    for r in split_audit(splits).collect():
        metrics[f"{r.version}_train_count"] = r.n_train
        metrics[f"{r.version}_val_count"] = r.n_val
        metrics[f"{r.version}_test_count"] = r.n_test
        params[f"{r.version}_train_val_test_ratio"] = r.ratio
    return registry.log_run(spark, root, experiment, params, metrics, [artifact])
