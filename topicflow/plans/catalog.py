"""Registered queries: one Spark job per SURVEY §2 operator over the driver
tables, each with an equivalent DuckDB SQL oracle where SQL can express it.

Every query reads the given tables (or data Spark derives from them), so
its work grows with them; no row caps, id subsets or prefixes.
"""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as Ty
from pyspark.sql import functions as F

from ..functions import clean, sqltext as S, text as T, tokens as K
from ..operators import (classify, collect, curves, epochs, features, metrics, morphology, sample, search, search_index, subwords,
                         taxonomy)
from ..operators.common import materialize
from ..plans import evaluate, prepare
from ..session import read_table, scratch_path
from ..sources import derive, readers, registry
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared SQL fragments
# ---------------------------------------------------------------------------
CORPUS_SQL = "SELECT doc_id, text, lang AS domain, source AS raw_target FROM documents"
LANGS_SQL = "['en', 'de', 'es', 'fr']"
TAX_SQL = f"""
SELECT domain, raw_target,
       'topic_' || lpad(CAST((CAST(regexp_extract(raw_target, '^src(\\d+)$', 1) AS INTEGER)
             + 5 * (list_position({LANGS_SQL}, domain) - 1)) % 20 AS VARCHAR), 2, '0') AS topic
FROM (SELECT DISTINCT lang AS domain, source AS raw_target FROM documents) p
WHERE list_position({LANGS_SQL}, domain) IS NOT NULL
  AND regexp_full_match(raw_target, 'src\\d+')
  AND NOT (domain = 'es' AND raw_target = 'src19')"""
KEY_SQL = S.md5_key("doc_id")
BALANCED_SQL = f"""
SELECT * FROM (
  SELECT c.*, row_number() OVER (PARTITION BY domain ORDER BY {KEY_SQL}, doc_id) AS rank
  FROM ({CORPUS_SQL}) c) r
WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang) g)"""


def _with(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


# ---------------------------------------------------------------------------
# Flagship
# ---------------------------------------------------------------------------
@register("balanced_topic_counts", _with(tax=TAX_SQL, bal=BALANCED_SQL) + f"""
SELECT b.domain, t.topic, count(*) AS n_sampled,
       CAST(sum(CASE WHEN {S.nonempty(S.light('b.text'))} THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
       round(sum(CASE WHEN {S.nonempty(S.light('b.text'))} THEN 1 ELSE 0 END) / count(*), 6) AS retention
FROM bal b LEFT JOIN tax t ON b.domain = t.domain AND b.raw_target = t.raw_target
GROUP BY b.domain, t.topic""")
def q_balanced_topic_counts(spark, sf):
    return prepare.balanced_topic_counts(derive.corpus(spark, sf), derive.derived_taxonomy(spark, sf))


# ---------------------------------------------------------------------------
# G01-G03, G18, G19, P03, P04
# ---------------------------------------------------------------------------
@register("corpus_profile", """
SELECT count(*) AS n_docs, count(DISTINCT lang) AS n_domains, count(DISTINCT source) AS n_targets
FROM documents""")
def q_corpus_profile(spark, sf):
    c = derive.corpus(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("domain").alias("n_domains"),
                 F.countDistinct("raw_target").alias("n_targets"))


@register("domain_sizes", """
SELECT lang AS domain, count(*) AS n_docs,
       min(count(*)) OVER () AS min_domain_size FROM documents GROUP BY lang""")
def q_domain_sizes(spark, sf):
    c = derive.corpus(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs"))
    # The minimum over a handful of groups (window over the small aggregate)
    return c.withColumn("min_domain_size", F.min("n_docs").over(Window.partitionBy()))


@register("taxonomy_map", _with(tax=TAX_SQL) + f"""
SELECT c.doc_id, c.domain, c.raw_target, t.topic
FROM ({CORPUS_SQL}) c LEFT JOIN tax t ON c.domain = t.domain AND c.raw_target = t.raw_target""")
def q_taxonomy_map(spark, sf):
    c = derive.corpus(spark, sf).drop("text")
    return taxonomy.map_topics(c, derive.derived_taxonomy(spark, sf)).select(
        "doc_id", "domain", "raw_target", "topic")


@register("taxonomy_check", _with(tax=TAX_SQL) + """
SELECT t.topic, count(*) AS n_keys,
       CAST(sum(CASE WHEN t.topic IN (SELECT 'topic_' || lpad(CAST(i AS VARCHAR), 2, '0') FROM range(20) r(i))
                THEN 0 ELSE 1 END) AS BIGINT) AS n_unknown
FROM tax t GROUP BY t.topic""")
def q_taxonomy_check(spark, sf):
    tax = derive.derived_taxonomy(spark, sf)
    bad = taxonomy.check_taxonomy(tax, derive.derived_topics(spark)).withColumn("_bad", F.lit(1))
    return (tax.join(bad.select("domain", "raw_target", "_bad"), ["domain", "raw_target"], "left")
            .groupBy("topic").agg(F.count(F.lit(1)).alias("n_keys"),
                                  F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("n_unknown")))


@register("labels_by_domain", """
SELECT DISTINCT lang AS domain, source AS raw_target FROM documents WHERE source IS NOT NULL""")
def q_labels_by_domain(spark, sf):
    return taxonomy.labels_by_domain(derive.corpus(spark, sf))


@register("unmapped_audit", _with(tax=TAX_SQL) + f"""
SELECT c.domain, c.raw_target, count(*) AS n_rows
FROM ({CORPUS_SQL}) c LEFT JOIN tax t ON c.domain = t.domain AND c.raw_target = t.raw_target
WHERE t.topic IS NULL GROUP BY c.domain, c.raw_target""")
def q_unmapped_audit(spark, sf):
    c = derive.corpus(spark, sf).drop("text")
    return taxonomy.unmapped_audit(taxonomy.map_topics(c, derive.derived_taxonomy(spark, sf)))


@register("value_counts", """
SELECT 'domain' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang
UNION ALL
SELECT 'primary_category', split_part(source, '.', 1), count(*) FROM documents GROUP BY split_part(source, '.', 1)""")
def q_value_counts(spark, sf):
    """G03 + P16: value counts by domain and by primary category."""
    d = read_table(spark, sf, "documents")
    a = d.groupBy(F.col("lang").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("field", F.lit("domain"))
    b = (d.groupBy(T.primary_category("source").alias("value")).agg(F.count(F.lit(1)).alias("n"))
         .withColumn("field", F.lit("primary_category")))
    return a.unionByName(b).select("field", "value", "n").orderBy(F.desc("n"), "field", "value")


# ---------------------------------------------------------------------------
# W00-W04 sampling and splits
# ---------------------------------------------------------------------------
@register("balanced_sample", _with(bal=BALANCED_SQL) + "SELECT doc_id, domain, rank FROM bal")
def q_balanced_sample(spark, sf):
    return sample.balanced_sample(derive.corpus(spark, sf).drop("text")).select("doc_id", "domain", "rank")


@register("exact_rank", f"""
SELECT doc_id, lang AS domain,
       row_number() OVER (PARTITION BY lang ORDER BY {KEY_SQL}, doc_id) AS rank
FROM documents""")
def q_exact_rank(spark, sf):
    return sample.exact_rank(derive.corpus(spark, sf).select("doc_id", "domain"), ["domain"])


@register("fraction_sample", f"""
SELECT doc_id, rank FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {KEY_SQL}, doc_id) AS rank FROM documents) r
WHERE rank <= (SELECT CAST(round_even(0.75 * count(*), 0) AS BIGINT) FROM documents)""")
def q_fraction_sample(spark, sf):
    """W02 with the reference's flagged-off value 0.75."""
    return sample.fraction_sample(derive.corpus(spark, sf).select("doc_id"), 0.75).select("doc_id", "rank")


@register("stratified_split", f"""
WITH r AS (
  SELECT doc_id, lang AS domain,
         row_number() OVER (PARTITION BY lang ORDER BY {KEY_SQL}, doc_id) AS rank,
         count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
s AS (SELECT *, (3 * n + 9) // 10 AS hold FROM r)
SELECT doc_id, domain, rank,
       CASE WHEN rank <= n - hold THEN 'train'
            WHEN rank <= n - hold + (hold - (hold + 1) // 2) THEN 'val' ELSE 'test' END AS split
FROM s""")
def q_stratified_split(spark, sf):
    return sample.stratified_split(derive.corpus(spark, sf).select("doc_id", "domain"), with_rank=True)


@register("size_samples", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {KEY_SQL}, doc_id) AS rank,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, rank, CAST(p.pct AS INTEGER) AS pct
FROM r, (VALUES (25), (50), (75), (100)) p(pct)
WHERE rank <= CAST(round_even(p.pct * n / 100.0, 0) AS BIGINT)""")
def q_size_samples(spark, sf):
    return sample.nested_size_samples(derive.corpus(spark, sf).select("doc_id")).select("doc_id", "rank", "pct")


# ---------------------------------------------------------------------------
# X01-X12, X17-X19, P05, P14, S07 cleaning
# ---------------------------------------------------------------------------
@register("clean_light_documents", f"SELECT doc_id, {S.light('text')} AS clean_text FROM documents")
def q_clean_light_documents(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", clean.clean_light("text").alias("clean_text"))


@register("clean_aggressive_documents", f"SELECT doc_id, {S.aggressive('text')} AS clean_text FROM documents")
def q_clean_aggressive_documents(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", clean.clean_aggressive("text").alias("clean_text"))


@register("clean_pages", f"""
SELECT page_id, {S.light('html')} AS light_text, {S.aggressive('html')} AS aggressive_text,
       substr({S.light('html')}, 1, 200) AS preview
FROM pages""")
def q_clean_pages(spark, sf):
    p = read_table(spark, sf, "pages")
    lt = clean.clean_light("html")
    return p.select("page_id", lt.alias("light_text"), clean.clean_aggressive("html").alias("aggressive_text"),
                    clean.preview(lt, 200).alias("preview"))


@register("clean_conversations", f"""
SELECT conv_id, turn, {S.light('text')} AS light_text, {S.aggressive('text')} AS aggressive_text
FROM conversations""")
def q_clean_conversations(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", clean.clean_light("text").alias("light_text"),
                    clean.clean_aggressive("text").alias("aggressive_text"))


@register("tfidf_text_documents", f"SELECT doc_id, {S.tfidf_text('text')} AS clean_text FROM documents")
def q_tfidf_text_documents(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", K.tfidf_text("text").alias("clean_text"))


@register("light_lemma_documents", f"SELECT doc_id, {S.light_lemma('text')} AS clean_text FROM documents")
def q_light_lemma_documents(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", K.light_lemma_text("text").alias("clean_text"))


@register("cleaning_audit", f"""
WITH v AS (
  SELECT 'tfidf' AS version, {S.tfidf_text('text')} AS t FROM documents
  UNION ALL SELECT 'transformer', {S.light('text')} FROM documents
  UNION ALL SELECT 'transformer_lem', {S.light_lemma('text')} FROM documents)
SELECT version, count(*) AS n_docs,
       CAST(sum(CASE WHEN {S.nonempty('t')} THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
       CAST(count(*) - sum(CASE WHEN {S.nonempty('t')} THEN 1 ELSE 0 END) AS BIGINT) AS n_filtered,
       round(sum(CASE WHEN {S.nonempty('t')} THEN 1 ELSE 0 END) / count(*), 6) AS retention
FROM v GROUP BY version""")
def q_cleaning_audit(spark, sf):
    v = prepare.cleaned_versions(derive.corpus(spark, sf))
    return prepare.cleaning_audit(v).select("version", "n_docs", "n_kept", "n_filtered", "retention")


def _split_sql() -> str:
    versions = f"""
  SELECT doc_id, lang AS domain, 'tfidf' AS version, {S.tfidf_text('text')} AS t FROM documents
  UNION ALL SELECT doc_id, lang, 'transformer', {S.light('text')} FROM documents
  UNION ALL SELECT doc_id, lang, 'transformer_lem', {S.light_lemma('text')} FROM documents"""
    return f"""
WITH v AS ({versions}),
k AS (SELECT * FROM v WHERE {S.nonempty('t')}),
r AS (SELECT doc_id, domain, version,
             row_number() OVER (PARTITION BY version, domain ORDER BY {KEY_SQL}, doc_id) AS rank,
             count(*) OVER (PARTITION BY version, domain) AS n FROM k),
s AS (SELECT *, (3 * n + 9) // 10 AS hold FROM r)
SELECT doc_id, domain, version, rank,
       CASE WHEN rank <= n - hold THEN 'train'
            WHEN rank <= n - hold + (hold - (hold + 1) // 2) THEN 'val' ELSE 'test' END AS split
FROM s"""


@register("version_splits", _split_sql())
def q_version_splits(spark, sf):
    v = prepare.narrow_versions(prepare.cleaned_versions(derive.corpus(spark, sf)))
    return prepare.split_versions(v, with_rank=True).select("doc_id", "domain", "version", "rank", "split")


@register("split_audit", "WITH sp AS (" + _split_sql() + """)
SELECT version,
       CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS n_val,
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
       CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS VARCHAR) || ':' ||
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS VARCHAR) || ':' ||
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS VARCHAR) AS ratio,
       round(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) / count(*), 6) AS train_pct,
       round(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) / count(*), 6) AS val_pct,
       round(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) / count(*), 6) AS test_pct
FROM sp GROUP BY version""")
def q_split_audit(spark, sf):
    v = prepare.narrow_versions(prepare.cleaned_versions(derive.corpus(spark, sf)))
    return prepare.split_audit(prepare.split_versions(v))


@register("prepared_corpus", _with(tax=TAX_SQL, bal=BALANCED_SQL) + f"""
, m AS (SELECT b.doc_id, b.domain, b.raw_target, t.topic, b.text
        FROM bal b LEFT JOIN tax t ON b.domain = t.domain AND b.raw_target = t.raw_target),
v AS (SELECT doc_id, domain, raw_target, topic, 'tfidf' AS version, {S.tfidf_text('text')} AS clean_text FROM m
      UNION ALL SELECT doc_id, domain, raw_target, topic, 'transformer', {S.light('text')} FROM m
      UNION ALL SELECT doc_id, domain, raw_target, topic, 'transformer_lem', {S.light_lemma('text')} FROM m),
k AS (SELECT * FROM v WHERE {S.nonempty('clean_text')}),
r AS (SELECT *, row_number() OVER (PARTITION BY version, domain ORDER BY {KEY_SQL}, doc_id) AS rank,
             count(*) OVER (PARTITION BY version, domain) AS n FROM k),
sp AS (SELECT *, (3 * n + 9) // 10 AS hold FROM r)
SELECT doc_id, domain, raw_target, topic, version, CAST(length(clean_text) AS INTEGER) AS clean_chars, rank,
       CASE WHEN rank <= n - hold THEN 'train'
            WHEN rank <= n - hold + (hold - (hold + 1) // 2) THEN 'val' ELSE 'test' END AS split
FROM sp""")
def q_prepared_corpus(spark, sf):
    """SURVEY §3.1 end to end: W01 balance -> P03 topics -> X18/X12/X19 ->
    P05 -> W03 split per version (the cleaned text is reported by length)."""
    out = prepare.prepare(derive.corpus(spark, sf), derive.derived_taxonomy(spark, sf), texts=False)
    return out.select("doc_id", "domain", "raw_target", "topic", "version", "clean_chars", "rank", "split")


def _run_log_sql() -> str:
    versions = f"""
  SELECT doc_id, lang AS domain, 'tfidf' AS version, {S.tfidf_text('text')} AS t FROM documents
  UNION ALL SELECT doc_id, lang, 'transformer', {S.light('text')} FROM documents
  UNION ALL SELECT doc_id, lang, 'transformer_lem', {S.light_lemma('text')} FROM documents"""
    kept = f"CASE WHEN {S.nonempty('t')} THEN 1 ELSE 0 END"
    return f"""
WITH v AS ({versions}),
a AS (SELECT version, count(*) AS n, sum({kept}) AS k FROM v GROUP BY version),
sp AS ({_split_sql()}),
c AS (SELECT version, split, count(*) AS n FROM sp GROUP BY version, split)
SELECT version || '_documents_count' AS key, CAST(k AS DOUBLE) AS value FROM a
UNION ALL SELECT version || '_documents_filtered', CAST(n - k AS DOUBLE) FROM a
UNION ALL SELECT 'final_' || version || '_retention_rate', round(k / n, 6) FROM a
UNION ALL SELECT version || '_' || split || '_count', CAST(n AS DOUBLE) FROM c"""


@register("run_log", _run_log_sql())
def q_run_log(spark, sf):
    """S15 + W07: a preparation run is logged with its audit metrics and the
    ``cleaned_data`` artifact; a later run without it follows; the newest run
    owning the artifact is found and its metrics are returned."""
    root = scratch_path(spark, "runs")
    # both audits read the cleaned versions: cleaned once, written without the texts
    versions = materialize(prepare.flagged_versions(prepare.cleaned_versions(derive.corpus(spark, sf))), "flagged")
    prepare.log_preparation(spark, root, versions, prepare.split_versions(prepare.narrow_versions(versions)))
    registry.log_run(spark, root, "evaluation", {"model": "none"}, {"accuracy": 0.0}, [])
    latest = registry.latest_run_with_artifact(registry.runs(spark, root), "cleaned_data").select("run_id")
    m = spark.read.parquet(f"{root}/run_metrics")
    return m.join(latest, "run_id").select("key", F.round("value", 6).alias("value"))


@register("newsgroup_body", """
WITH h AS (
  SELECT doc_id, CASE WHEN strpos(text, chr(10) || chr(10)) > 0
                      THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE '' END AS t
  FROM documents),
f AS (
  SELECT doc_id, t,
         string_split(regexp_replace(t, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g'), chr(10)) AS lines
  FROM h),
g AS (
  SELECT doc_id, t, lines,
         list_max(list_filter(range(1, len(lines) + 1),
                  lambda i: regexp_full_match(lines[i], '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*-*[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*'))) AS last
  FROM f),
ft AS (
  SELECT doc_id, CASE WHEN coalesce(last, 0) > 1 THEN array_to_string(lines[1:last - 1], chr(10)) ELSE t END AS t
  FROM g)
SELECT doc_id,
       array_to_string(list_filter(string_split(t, chr(10)),
         lambda ln: NOT regexp_matches(ln, '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)')), chr(10)) AS body
FROM ft""")
def q_newsgroup_body(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", clean.newsgroup_body("text").alias("body"))


# ---------------------------------------------------------------------------
# Metrics over a deterministic predictions table
# ---------------------------------------------------------------------------
def _pred_sql(salt: str = "p", model: str = "fixed_predictor") -> str:
    h = f"md5('{salt}:' || CAST(doc_id AS VARCHAR))"
    return f"""
SELECT '{model}' AS model, doc_id, lang AS domain, lang AS y,
       CASE WHEN substr({h}, 1, 2) = 'ff' THEN 'xx'
            WHEN substr({h}, 1, 1) <= 'b' THEN lang
            ELSE CASE lang WHEN 'en' THEN 'de' WHEN 'de' THEN 'es' WHEN 'es' THEN 'fr' WHEN 'fr' THEN 'en' END
       END AS p
FROM documents"""


MODELS3 = (("p", "classic"), ("q", "neural"), ("r", "neural_lem"))
PRED3_SQL = " UNION ALL ".join(_pred_sql(s_, m) for s_, m in MODELS3)


def _preds3(spark, sf):
    out = None
    for salt, model in MODELS3:
        d = derive.predictions(spark, sf, salt, model)
        out = d if out is None else out.unionByName(d)
    return out


def _stats_sql(by: str, labels: str) -> str:
    """SQL per-label stats over CTE ``c(by..., y, p, n)``."""
    g = f"{by}, " if by else ""
    on = " AND ".join([f"ts.{b.strip()} = ps.{b.strip()}" for b in by.split(",") if b.strip()] + ["ts.label = ps.label"])
    co = "".join(f"coalesce(ts.{b.strip()}, ps.{b.strip()}) AS {b.strip()}, " for b in by.split(",") if b.strip())
    how = "FULL JOIN" if labels == "union" else "LEFT JOIN"
    return f"""
SELECT {co}coalesce(ts.label, ps.label) AS label, CAST(coalesce(support, 0) AS BIGINT) AS support,
       CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(tp, 0) AS BIGINT) AS tp,
       CASE WHEN coalesce(predicted, 0) > 0 THEN tp / predicted ELSE 0 END AS precision,
       CASE WHEN coalesce(support, 0) > 0 THEN coalesce(tp, 0) / support ELSE 0 END AS recall
FROM (SELECT {g}y AS label, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM c GROUP BY {g}y) ts
{how} (SELECT {g}p AS label, sum(n) AS predicted FROM c GROUP BY {g}p) ps ON {on}"""


def _f1(pr="precision", rc="recall") -> str:
    return f"CASE WHEN {pr} + {rc} > 0 THEN 2 * {pr} * {rc} / ({pr} + {rc}) ELSE 0 END"


@register("metrics_summary", f"""
WITH pr AS ({PRED3_SQL}),
c AS (SELECT model, y, p, count(*) AS n FROM pr GROUP BY model, y, p),
su AS ({_stats_sql('model', 'union')}),
sp AS ({_stats_sql('model', 'present')}),
a AS (SELECT model, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS accuracy FROM c GROUP BY model)
SELECT a.model, a.n, round(a.accuracy, 6) AS accuracy,
       round((SELECT avg({_f1()}) FROM su WHERE su.model = a.model), 6) AS f1_macro_union,
       round((SELECT avg({_f1()}) FROM sp WHERE sp.model = a.model), 6) AS f1_macro_present
FROM a""")
def q_metrics_summary(spark, sf):
    """G06 + G07 + G08 for three predictors (M10 comparison, overall)."""
    m = metrics.summary(_preds3(spark, sf), ["model"])
    return m.select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro_union", "f1_macro_present")])


@register("metrics_by_domain", f"""
WITH pr AS ({PRED3_SQL}),
c AS (SELECT model, domain, y, p, count(*) AS n FROM pr GROUP BY model, domain, y, p),
su AS ({_stats_sql('model, domain', 'union')}),
sp AS ({_stats_sql('model, domain', 'present')}),
a AS (SELECT model, domain, CAST(sum(n) AS BIGINT) AS n,
             sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS accuracy FROM c GROUP BY model, domain)
SELECT a.model, a.domain, a.n, round(a.accuracy, 6) AS accuracy,
       round((SELECT avg({_f1()}) FROM su WHERE su.model = a.model AND su.domain = a.domain), 6) AS f1_macro_union,
       round((SELECT avg({_f1()}) FROM sp WHERE sp.model = a.model AND sp.domain = a.domain), 6) AS f1_macro_present
FROM a""")
def q_metrics_by_domain(spark, sf):
    """Per-domain evaluation in one groupBy, never a loop."""
    m = metrics.summary(_preds3(spark, sf), ["model", "domain"])
    return m.select("model", "domain", "n",
                    *[F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro_union", "f1_macro_present")])


@register("class_report", f"""
WITH pr AS ({_pred_sql()}),
c AS (SELECT y, p, count(*) AS n FROM pr GROUP BY y, p),
st AS ({_stats_sql('', 'present')}),
f AS (SELECT *, {_f1()} AS f1 FROM st),
lab AS (SELECT sum(tp) AS tp, sum(predicted) AS pred, sum(support) AS sup FROM st),
tot AS (SELECT sum(n) AS n, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp_all,
               sum(CASE WHEN p NOT IN (SELECT label FROM st) THEN n ELSE 0 END) AS outside FROM c),
mi AS (SELECT CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS mp, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS mr,
              sup, n, tp_all, outside FROM lab, tot)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT CASE WHEN outside > 0 OR sup < n THEN 'micro avg' ELSE 'accuracy' END,
                 CASE WHEN outside > 0 OR sup < n THEN round(mp, 6) END, CASE WHEN outside > 0 OR sup < n THEN round(mr, 6) END,
                 round(CASE WHEN outside > 0 OR sup < n THEN {_f1('mp', 'mr')} ELSE tp_all / n END, 6),
                 CAST(CASE WHEN outside > 0 OR sup < n THEN sup ELSE n END AS BIGINT) FROM mi""")
def q_class_report(spark, sf):
    """G09 with labels present in y (a predicted-only label -> micro avg row)."""
    r = metrics.classification_report(derive.predictions(spark, sf), labels="present")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("report_text", f"""
WITH r AS ({ORACLE['class_report']}),
k AS (SELECT *, CASE label WHEN 'accuracy' THEN 3 WHEN 'micro avg' THEN 4 WHEN 'macro avg' THEN 5 WHEN 'weighted avg' THEN 6 ELSE 1 END AS part FROM r),
w AS (SELECT greatest(max(length(label)), 12) AS width FROM r),
l AS (SELECT 0 AS part, '' AS label, repeat(' ', width) || lpad('precision', 10, ' ') || lpad('recall', 10, ' ')
             || lpad('f1-score', 10, ' ') || lpad('support', 10, ' ') AS line FROM w
      UNION ALL SELECT 0, 'a', '' UNION ALL SELECT 2, '', ''
      UNION ALL SELECT part, label, lpad(label, CAST(width AS INTEGER), ' ')
             || lpad(CASE WHEN precision IS NULL THEN '' ELSE printf('%.4f', precision) END, 10, ' ')
             || lpad(CASE WHEN recall IS NULL THEN '' ELSE printf('%.4f', recall) END, 10, ' ')
             || lpad(printf('%.4f', f1), 10, ' ') || lpad(CAST(support AS VARCHAR), 10, ' ') FROM k, w)
SELECT CAST(row_number() OVER (ORDER BY part, label) AS INTEGER) AS line_no, line FROM l""")
def q_report_text(spark, sf):
    """The class report as the text that is written, line by line."""
    report = metrics.classification_report(derive.predictions(spark, sf), labels="present")
    rounded = report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
    path = scratch_path(spark, "report")
    metrics.write_report(rounded, path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("i", "line"))
    return lines.select((F.col("i") + 1).alias("line_no"), "line")


@register("confusion_grid", f"""
WITH pr AS ({PRED3_SQL}),
c AS (SELECT model, y, p, count(*) AS n FROM pr GROUP BY model, y, p),
l AS (SELECT DISTINCT model, y AS label FROM c),
g AS (SELECT a.model, a.label AS y, b.label AS p FROM l a JOIN l b ON a.model = b.model)
SELECT g.model, g.y, g.p, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.model = c.model AND g.y = c.y AND g.p = c.p""")
def q_confusion_grid(spark, sf):
    """G10 + J06: zero-filled label x label grid per model."""
    return metrics.confusion_grid(_preds3(spark, sf), ["model"])


@register("union_labels", f"SELECT DISTINCT label FROM (SELECT y AS label FROM ({_pred_sql()}) UNION ALL SELECT p FROM ({_pred_sql()}))")
def q_union_labels(spark, sf):
    """U03."""
    return metrics.union_labels(derive.predictions(spark, sf))


@register("class_weights", """
SELECT lang AS label, count(*) AS n_c,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM documents GROUP BY lang""")
def q_class_weights(spark, sf):
    """Balanced weights of the language labels."""
    w = metrics.class_weights(read_table(spark, sf, "documents").select(F.col("lang").alias("label")))
    return w.select("label", "n_c", F.round("weight", 6).alias("weight"))


@register("score_matrix", f"""
WITH pr AS ({PRED3_SQL}),
s AS (SELECT model, domain, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS acc FROM pr GROUP BY model, domain)
SELECT model,
       coalesce(max(CASE WHEN domain = 'en' THEN acc END), 0) AS en,
       coalesce(max(CASE WHEN domain = 'de' THEN acc END), 0) AS de,
       coalesce(max(CASE WHEN domain = 'es' THEN acc END), 0) AS es,
       coalesce(max(CASE WHEN domain = 'fr' THEN acc END), 0) AS fr,
       coalesce(max(CASE WHEN domain = 'xx' THEN acc END), 0) AS xx
FROM s GROUP BY model""")
def q_score_matrix(spark, sf):
    """Model x slice matrix on a known slice list; missing -> 0."""
    s = (_preds3(spark, sf).groupBy("model", "domain")
         .agg(F.round(F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0)), 6).alias("acc")))
    return metrics.score_matrix(s, "model", "domain", "acc", ["en", "de", "es", "fr", "xx"])


@register("label_index", """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_id
FROM (SELECT DISTINCT lang AS label FROM documents)""")
def q_label_index(spark, sf):
    """Alphabetical label ids fitted on the labels (StringIndexer)."""
    d = read_table(spark, sf, "documents").select(F.col("lang").alias("label"))
    idx = classify.label_indexer(d, "label")
    return idx.transform(d.distinct()).select("label", F.col("label_id"))


# ---------------------------------------------------------------------------
# TF-IDF on the TF-IDF text version
# ---------------------------------------------------------------------------
TFP = features.TfidfParams()


def _terms_sql() -> str:
    toks = f"regexp_extract_all(lower({S.tfidf_text('text')}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"""
SELECT doc_id, list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS terms
FROM (SELECT doc_id, {toks} AS toks FROM documents) x"""


TF_SQL = f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM ({_terms_sql()}) d) e
GROUP BY doc_id, term"""
VOCAB_SQL = f"""
SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, (SELECT count(*) FROM documents) AS n
  FROM tf GROUP BY term) s
WHERE df >= {TFP.min_df} AND df <= {TFP.max_df!r} * n
ORDER BY cf DESC, term LIMIT {TFP.max_features}"""


def _tfidf_docs(spark, sf, reuse: bool = False):
    """TF-IDF text version of every document. When both the fit and the
    transform read it, it is written once (lineage cut) so the regex
    cleaning runs a single time."""
    d = read_table(spark, sf, "documents").select("doc_id", K.tfidf_text("text").alias("text"))
    return materialize(d, "tfidf_text") if reuse else d


@register("term_stats", f"WITH tf AS ({TF_SQL}) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def q_term_stats(spark, sf):
    words = features.with_terms(_tfidf_docs(spark, sf), ngram_max=1)
    return features.term_stats(features.term_frequencies(words, ngrams=(TFP.ngram_min, TFP.ngram_max), per_doc=False))


@register("vocabulary", f"""WITH tf AS ({TF_SQL}), v AS ({VOCAB_SQL})
SELECT term, df, cf, round(idf, 6) AS idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS "index" FROM v""")
def q_vocabulary(spark, sf):
    v = features.fit_tfidf(_tfidf_docs(spark, sf), TFP)
    return v.select("term", "df", "cf", F.round("idf", 6).alias("idf"), "index")


@register("tfidf_long", f"""WITH tf AS ({TF_SQL}), v AS ({VOCAB_SQL}),
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * v.idf AS w FROM tf JOIN v ON tf.term = v.term)
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def q_tfidf_long(spark, sf):
    docs = _tfidf_docs(spark, sf, reuse=True)
    v = features.fit_tfidf(docs, TFP)
    return features.tfidf_long(docs, v, TFP).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@register("doc_norms", f"""WITH tf AS ({TF_SQL}), v AS ({VOCAB_SQL}),
w AS (SELECT tf.doc_id, tf.tf * v.idf AS w FROM tf JOIN v ON tf.term = v.term),
x AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT doc_id, round(sqrt(sum(weight * weight)), 6) AS norm FROM x GROUP BY doc_id""")
def q_doc_norms(spark, sf):
    docs = _tfidf_docs(spark, sf, reuse=True)
    v = features.fit_tfidf(docs, TFP)
    n = features.doc_norms(features.tfidf_long(docs, v, TFP))
    return n.select("doc_id", F.round("norm", 6).alias("norm"))


# ---------------------------------------------------------------------------
# Posts derived from documents
# ---------------------------------------------------------------------------
D_EDGE = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {S.q(D_EDGE)}, '', 'g')"


POSTS_BASE_SQL = """
SELECT CAST(d.doc_id AS VARCHAR) AS id,
       split_part(d.text, chr(10), 1) AS title,
       CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS selftext,
       d.source AS subreddit,
       CASE WHEN l.toxic = 1 THEN ' Flagged ' END AS link_flair_text,
       CAST(1700000000 + d.doc_id * 60 AS DOUBLE) AS created_utc,
       '/r/' || d.source || '/comments/' || CAST(d.doc_id AS VARCHAR) || '/' AS permalink,
       strpos(d.text, chr(10)) > 0 AND length(substr(d.text, strpos(d.text, chr(10)) + 1)) > 0 AS is_self,
       l.toxic = 1 AS over_18,
       CAST(d.n_chars % 97 AS INTEGER) AS num_comments,
       CAST(d.n_chars % 1000 AS INTEGER) AS score,
       CAST(CASE WHEN l.quality IS NOT NULL THEN 0.5 + l.quality * 0.4 END AS DOUBLE) AS upvote_ratio,
       0 AS copy
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
POSTS_SQL = f"""
SELECT * FROM ({POSTS_BASE_SQL}) b
UNION ALL SELECT * REPLACE (1 AS copy) FROM ({POSTS_BASE_SQL}) c WHERE CAST(id AS BIGINT) % 10 = 0"""
SER_SQL = f"""{_strip_sql("coalesce(title, '') || chr(10) || chr(10) || coalesce(selftext, '')")} AS text,
       id, subreddit, link_flair_text AS flair,
       strftime(make_timestamp(CAST(created_utc * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_utc,
       'https://www.reddit.com' || permalink AS permalink, coalesce(is_self, false) AS is_self,
       coalesce(over_18, false) AS over_18, coalesce(num_comments, 0) AS num_comments,
       coalesce(score, 0) AS score, upvote_ratio"""
SRC_K = "CAST(regexp_extract(source, '^src(\\d+)$', 1) AS INTEGER)"
TOPICMAP_SQL = f"""
SELECT DISTINCT source AS subreddit, {SRC_K} AS k, 'T' || CAST({SRC_K} % 7 AS VARCHAR) AS topic,
       {SRC_K} % 7 AS topic_pos
FROM documents WHERE regexp_full_match(source, 'src\\d+') AND source <> 'src19'"""


def _label_sql(mode: str = "hybrid") -> str:
    fl = _strip_sql("coalesce(link_flair_text, '')")
    sub = "coalesce(CASE WHEN bucket <> '' THEN bucket END, subreddit)"
    if mode == "subreddit":
        return sub
    return f"CASE WHEN {fl} <> '' THEN {fl} ELSE {sub} END"


def _topic_map(spark, sf):
    return derive.topic_map(spark, sf)


@register("topic_map_inverted", f"SELECT lower(subreddit) AS sub_key, topic AS bucket FROM ({TOPICMAP_SQL}) t")
def q_topic_map_inverted(spark, sf):
    return collect.invert_topic_map(_topic_map(spark, sf))


@register("posts_serialized", f"SELECT copy, {SER_SQL} FROM ({POSTS_SQL}) p")
def q_posts_serialized(spark, sf):
    return collect.serialize_posts(derive.posts(spark, sf), include_title=True, full=True, keep=["copy"])


@register("posts_text_body_first", f"""
SELECT id, copy, CASE WHEN coalesce(selftext, '') <> '' THEN selftext ELSE coalesce(title, '') END AS text
FROM ({POSTS_SQL}) p""")
def q_posts_text_body_first(spark, sf):
    """P08 default arm: body, else title."""
    return collect.serialize_posts(derive.posts(spark, sf), include_title=False, full=False, keep=["id", "copy"])


@register("posts_labeled", f"""
WITH inv AS (SELECT lower(subreddit) AS sub_key, topic AS bucket FROM ({TOPICMAP_SQL}) t)
SELECT id, copy, {_label_sql('hybrid')} AS label_hybrid, {_label_sql('subreddit')} AS label_subreddit
FROM ({POSTS_SQL}) p LEFT JOIN inv ON lower(p.subreddit) = inv.sub_key""")
def q_posts_labeled(spark, sf):
    """P10 + J02 in hybrid (= flair) and subreddit modes."""
    posts = derive.posts(spark, sf)
    inv = collect.invert_topic_map(_topic_map(spark, sf))
    h = collect.assign_label(posts, inv, "hybrid").withColumnRenamed("label", "label_hybrid")
    sub = collect.assign_label(h, inv, "subreddit").withColumnRenamed("label", "label_subreddit")
    return sub.select("id", "copy", "label_hybrid", "label_subreddit")


@register("posts_with_text", f"""
SELECT id, copy FROM ({POSTS_SQL}) p
WHERE length({_strip_sql("coalesce(title, '')")}) > 0 OR length({_strip_sql("coalesce(selftext, '')")}) > 0""")
def q_posts_with_text(spark, sf):
    """Title or body has text."""
    return derive.posts(spark, sf).where(T.has_text("title", "selftext")).select("id", "copy")


HOT_SQL = ("sign(CAST(score AS DOUBLE)) * log10(greatest(abs(CAST(score AS DOUBLE)), 1.0)) "
           "+ (created_utc - 1134028003) / 45000.0")
LISTING_ORDER = {
    "hot": f"{HOT_SQL} DESC, id, copy",
    "new": "created_utc DESC, id, copy",
    "top": "score DESC, created_utc DESC, id, copy",
    "search": "created_utc DESC, id, copy",
}


@register("posts_listing", f"""
WITH posts AS ({POSTS_SQL}), mx AS (SELECT max(created_utc) AS as_of FROM posts),
n AS (SELECT 'new' AS mode, id, copy, subreddit,
             row_number() OVER (PARTITION BY subreddit ORDER BY {LISTING_ORDER['new']}) AS listing_rank FROM posts),
t AS (SELECT 'top' AS mode, id, copy, subreddit,
             row_number() OVER (PARTITION BY subreddit ORDER BY {LISTING_ORDER['top']}) AS listing_rank
      FROM posts, mx WHERE created_utc > mx.as_of - {7 * 86400}),
s AS (SELECT 'search' AS mode, id, copy, subreddit,
             row_number() OVER (PARTITION BY subreddit ORDER BY {LISTING_ORDER['search']}) AS listing_rank
      FROM posts, mx WHERE created_utc > mx.as_of - {30 * 86400}
        AND strpos(lower(coalesce(title, '') || chr(10) || coalesce(selftext, '')), 'the') > 0)
, h AS (SELECT 'hot' AS mode, id, copy, subreddit,
             row_number() OVER (PARTITION BY subreddit ORDER BY {LISTING_ORDER['hot']}) AS listing_rank FROM posts)
SELECT mode, id, copy, subreddit, CAST(listing_rank AS INTEGER) AS listing_rank FROM (
  SELECT * FROM n WHERE listing_rank <= 25
  UNION ALL SELECT * FROM h WHERE listing_rank <= 25
  UNION ALL SELECT * FROM t WHERE listing_rank <= 25
  UNION ALL SELECT * FROM s WHERE listing_rank <= 25) u""")
def q_posts_listing(spark, sf):
    """New and hot (limit 25), top of the last week, search 'the' in the
    last month; time filters relative to the newest post."""
    posts = derive.posts(spark, sf).select("id", "copy", "subreddit", "score", "created_utc",
                                           collect.matches("the").alias("found"))   # narrow: no text is ranked
    as_of = posts.agg(F.max("created_utc")).first()[0]
    out = None
    for mode, tf, qy in (("new", "all", None), ("hot", "all", None), ("top", "week", None),
                         ("search", "month", "the")):
        lst = collect.list_posts(posts, mode, 25, tf, qy, as_of, match=F.col("found")).select(
            F.lit(mode).alias("mode"), "id", "copy", "subreddit", "listing_rank")
        out = lst if out is None else out.unionByName(lst)
    return out


@register("search_index_listing", f"""
WITH posts AS ({POSTS_SQL}), mx AS (SELECT max(created_utc) AS as_of FROM posts),
q AS (SELECT unnest(['the', 'tion', 'zeitung', 'the and']) AS query),
s AS (SELECT query, id, copy, subreddit,
             row_number() OVER (PARTITION BY query, subreddit ORDER BY {LISTING_ORDER['search']}) AS listing_rank
      FROM posts, mx, q WHERE created_utc > mx.as_of - {30 * 86400}
        AND strpos(lower(coalesce(title, '') || chr(10) || coalesce(selftext, '')), query) > 0)
SELECT query, id, copy, subreddit, CAST(listing_rank AS INTEGER) AS listing_rank FROM s WHERE listing_rank <= 25""")
def q_search_index_listing(spark, sf):
    """S13 search through the inverted index: original posts are indexed, the
    copies appended; each query's rows come from its buckets' postings."""
    folder = scratch_path(spark, "index")
    posts = derive.posts(spark, sf)
    keep = ["id", "copy", "subreddit", "created_utc"]
    for copy in (0, 1):
        search_index.append(posts.where(F.col("copy") == copy), folder, keep)
    as_of = spark.read.parquet(f"{folder}/posts").agg(F.max("created_utc")).first()[0]
    out = None
    for query in ("the", "tion", "zeitung", "the and"):
        found = search_index.search(spark, folder, query, posts, ["id", "copy"])
        one = collect.list_posts(found, "search", 25, "month", query, as_of, match=F.lit(True)).select(
            F.lit(query).alias("query"), "id", "copy", "subreddit", "listing_rank")
        out = one if out is None else out.unionByName(one)
    return out


@register("posts_first_seen", f"""
SELECT id, copy, subreddit FROM (
  SELECT id, copy, subreddit, row_number() OVER (PARTITION BY id ORDER BY subreddit, created_utc DESC, copy) AS rn
  FROM ({POSTS_SQL}) p) x WHERE rn = 1""")
def q_posts_first_seen(spark, sf):
    """First occurrence of each post id."""
    p = derive.posts(spark, sf).select("id", "copy", "subreddit", F.col("created_utc"))
    p = p.withColumn("neg_created", -F.col("created_utc"))
    return collect.dedup_first_seen(p, ["subreddit", "neg_created", "copy"]).select("id", "copy", "subreddit")


QUOTA = dict(target_count=300, per_subreddit_limit=40)


@register("posts_collect_topic", f"""
WITH posts AS ({POSTS_SQL}),
tm AS ({TOPICMAP_SQL}),
subs AS (SELECT topic, topic_pos, subreddit,
                row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || topic || ':' || subreddit), subreddit) AS sub_pos
         FROM tm),
p AS (SELECT posts.*, s.topic, s.topic_pos, s.sub_pos FROM posts JOIN subs s ON lower(posts.subreddit) = lower(s.subreddit)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY {LISTING_ORDER['top']}) AS listing_rank FROM p) x
      WHERE listing_rank <= {QUOTA['per_subreddit_limit']}
        AND (length({_strip_sql("coalesce(title, '')")}) > 0 OR length({_strip_sql("coalesce(selftext, '')")}) > 0)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY topic_pos, sub_pos, listing_rank) AS rn FROM l) x WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sub_pos, listing_rank) AS topic_rank FROM f),
k AS (SELECT * FROM r WHERE topic_rank <= greatest(1, {QUOTA['target_count']} // (SELECT count(DISTINCT topic) FROM tm))),
c AS (SELECT topic, topic_pos, count(*) AS n FROM k GROUP BY topic, topic_pos),
b AS (SELECT topic, greatest(0, {QUOTA['target_count']} - coalesce(sum(n) OVER (ORDER BY topic_pos, topic
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS budget FROM c),
fin AS (SELECT k.* FROM k JOIN b ON k.topic = b.topic WHERE topic_rank <= budget),
inv AS (SELECT lower(subreddit) AS sub_key, topic AS bucket FROM tm)
SELECT topic, CAST(topic_rank AS INTEGER) AS topic_rank, {_label_sql('hybrid')} AS label, {SER_SQL}
FROM fin LEFT JOIN inv ON lower(fin.subreddit) = inv.sub_key""")
def q_posts_collect_topic(spark, sf):
    """W06 topic mode: top listings, 40 pulled per subreddit, 300 in total."""
    return collect.collect_by_topic(derive.posts(spark, sf), _topic_map(spark, sf), mode="top",
                                    time_filter="all", **QUOTA)


@register("posts_collect_subreddit", f"""
WITH posts AS ({POSTS_SQL}),
subs AS (SELECT lower(s) AS sub_key, row_number() OVER (ORDER BY {SRC_K.replace('source', 's')}, s) AS sub_pos
         FROM (SELECT DISTINCT source AS s FROM documents) d),
p AS (SELECT posts.*, subs.sub_pos FROM posts JOIN subs ON lower(posts.subreddit) = subs.sub_key),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY {LISTING_ORDER['new']}) AS listing_rank FROM p) x
      WHERE listing_rank <= {QUOTA['per_subreddit_limit']}
        AND (length({_strip_sql("coalesce(title, '')")}) > 0 OR length({_strip_sql("coalesce(selftext, '')")}) > 0)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sub_pos, listing_rank) AS rn FROM l) x WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY sub_pos ORDER BY listing_rank) AS sub_rank FROM f),
k AS (SELECT * FROM r WHERE sub_rank <= greatest(1, {QUOTA['target_count']} // (SELECT count(*) FROM subs))),
c AS (SELECT subreddit, sub_pos, count(*) AS n FROM k GROUP BY subreddit, sub_pos),
b AS (SELECT subreddit, greatest(0, {QUOTA['target_count']} - coalesce(sum(n) OVER (ORDER BY sub_pos, subreddit
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS budget FROM c),
fin AS (SELECT k.*, NULL AS bucket FROM k JOIN b ON k.subreddit = b.subreddit WHERE sub_rank <= budget)
SELECT CAST(sub_pos AS INTEGER) AS sub_pos, CAST(sub_rank AS INTEGER) AS sub_rank,
       {_label_sql('hybrid')} AS label, {SER_SQL} FROM fin""")
def q_posts_collect_subreddit(spark, sf):
    """W06 subreddit mode over every subreddit of the table (ordered by number)."""
    posts = derive.posts(spark, sf)
    number = F.regexp_extract("source", r"^src(\d+)$", 1).cast("int")
    subs = read_table(spark, sf, "documents").select("source").distinct()
    subs = subs.select(F.col("source").alias("subreddit"),
                       F.row_number().over(Window.orderBy(number, "source")).alias("sub_pos"))   # one row per subreddit
    return collect.collect_by_subreddit(posts, subs, mode="new", **QUOTA)


# ---------------------------------------------------------------------------
# W04 + G16 + W09 + P17: curve tables from predictions on nested size samples
# ---------------------------------------------------------------------------
CURVE_SQL = f"""
WITH pr AS ({PRED3_SQL}),
ids AS (SELECT doc_id, row_number() OVER (ORDER BY {KEY_SQL}, doc_id) AS rank, count(*) OVER () AS n FROM documents),
sz AS (SELECT doc_id, CAST(p.pct AS INTEGER) AS pct FROM ids, (VALUES (25), (50), (75), (100)) p(pct)
       WHERE rank <= CAST(round_even(p.pct * n / 100.0, 0) AS BIGINT)),
c AS (SELECT model, pct, y, p, count(*) AS n FROM pr JOIN sz USING (doc_id) GROUP BY model, pct, y, p),
sp AS ({_stats_sql('model, pct', 'present')}),
a AS (SELECT model, pct, sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS accuracy FROM c GROUP BY model, pct),
curve AS (SELECT a.model, a.pct, a.accuracy,
                 (SELECT avg({_f1()}) FROM sp WHERE sp.model = a.model AND sp.pct = a.pct) AS f1_score FROM a)"""


def _curve(spark, sf):
    return curves.curve_from_predictions(_preds3(spark, sf))


@register("performance_table", CURVE_SQL + """
SELECT array_to_string(list_transform(string_split(replace(model, '_', ' '), ' '),
                                      lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS Model,
       pct AS Dataset_Size_Percent, round(f1_score, 6) AS F1_Score, round(accuracy, 6) AS Accuracy
FROM curve""")
def q_performance_table(spark, sf):
    t = curves.performance_table(_curve(spark, sf))
    return t.select("Model", "Dataset_Size_Percent", F.round("F1_Score", 6).alias("F1_Score"),
                    F.round("Accuracy", 6).alias("Accuracy"))


@register("curve_matrix", CURVE_SQL + """
SELECT model,
       round(max(CASE WHEN pct = 25 THEN f1_score END), 6) AS p25, round(max(CASE WHEN pct = 50 THEN f1_score END), 6) AS p50,
       round(max(CASE WHEN pct = 75 THEN f1_score END), 6) AS p75, round(max(CASE WHEN pct = 100 THEN f1_score END), 6) AS p100
FROM curve GROUP BY model""")
def q_curve_matrix(spark, sf):
    m = curves.curve_matrix(_curve(spark, sf), "f1_score")
    return m.select("model", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "p100")])


@register("improvement_rates", CURVE_SQL + """
SELECT * FROM (
  SELECT model, pct,
         round(f1_score - lag(f1_score) OVER (PARTITION BY model ORDER BY pct), 6) AS f1_improvement,
         round(accuracy - lag(accuracy) OVER (PARTITION BY model ORDER BY pct), 6) AS accuracy_improvement
  FROM curve) x WHERE f1_improvement IS NOT NULL""")
def q_improvement_rates(spark, sf):
    r = curves.improvement_rates(_curve(spark, sf))
    return r.select("model", "pct", F.round("f1_improvement", 6).alias("f1_improvement"),
                    F.round("accuracy_improvement", 6).alias("accuracy_improvement"))


# ---------------------------------------------------------------------------
# Models (fitted by iterative optimisers; SQL states counts and floors)
# ---------------------------------------------------------------------------
def _labelled_split(spark, sf, version: str = "tfidf") -> DataFrame:
    """Cleaned text of one version, label = language, W03 split by domain. The
    text is cleaned and written once, as every fit reads it several times; the
    split is told by cut keys as the rows are read."""
    c = derive.corpus(spark, sf)
    v = c.select("doc_id", "domain", F.col("domain").alias("label"),
                 prepare.version_text(version, "text").alias("text"))
    v = materialize(v.where(clean.is_nonempty("text")), "clean")
    return sample.stratified_split(v, by="domain")


# What SQL can state of a fitted model: the rows each split or slice holds, and
# that the scores reach the floors below (language is clearly learnable; the
# measured scores are in the README).
CLASSIC_FLOOR, DENSE_FLOOR = 0.95, 0.80
TRIAL_FLOOR = 0.50


def _split_counts_sql(version: str) -> str:
    return f"SELECT split, count(*) AS n FROM ({_split_sql()}) sp WHERE version = '{version}' GROUP BY split"


def _eval_summary(scored: DataFrame, model: str, floor: float) -> DataFrame:
    m = metrics.summary(scored.select("split", F.col("label").alias("y"), F.col("predicted_label").alias("p")),
                        ["split"])
    return m.select(F.lit(model).alias("model"), "split", "n", (F.col("accuracy") >= floor).alias("accuracy_floor_met"),
                    (F.col("f1_macro_union") >= floor).alias("f1_floor_met"))


@register("classic_train_eval", f"""
SELECT 'logistic_regression' AS model, split, n, true AS accuracy_floor_met, true AS f1_floor_met
FROM ({_split_counts_sql('tfidf')}) c""")
def q_classic_train_eval(spark, sf):
    """M03 + M05 + G06-G08: TF-IDF (1,2)-grams + balanced multinomial logistic
    regression on the train split, metrics per split."""
    data = _labelled_split(spark, sf, "tfidf")
    model = classify.train_classic(data.where(F.col("split") == "train"))
    return _eval_summary(classify.score(data, model, "logistic_regression"), "logistic_regression", CLASSIC_FLOOR)


@register("dense_train_eval", f"""
SELECT 'transformer' AS model, split, n, true AS accuracy_floor_met, true AS f1_floor_met
FROM ({_split_counts_sql('transformer')}) c""")
def q_dense_train_eval(spark, sf):
    """M08 re-aimed: Word2Vec + perceptron on the light text version."""
    data = _labelled_split(spark, sf, "transformer")
    model = classify.train_dense(data.where(F.col("split") == "train"))
    scored = model.transform(data).select("doc_id", "split", "label", "predicted_label")
    return _eval_summary(scored, "transformer", DENSE_FLOOR)


@register("model_comparison", f"""
WITH sp AS ({_split_sql()}),
m AS (SELECT * FROM (VALUES ('logistic_regression', 'tfidf'), ('transformer', 'transformer'),
                            ('transformer_lemmatized', 'transformer_lem')) x(model, version))
SELECT model, 'test' AS slice, count(*) AS n, true AS floor_met FROM m JOIN sp USING (version) WHERE split = 'test' GROUP BY model
UNION ALL
SELECT model, domain, count(*), true FROM m JOIN sp USING (version) WHERE split = 'train' GROUP BY model, domain""")
def q_model_comparison(spark, sf):
    """Logistic regression (TF-IDF text) and the dense arm on light and
    lemmatised text, on the test split and per domain of the training split;
    a domain holds one label here, so its floor is on accuracy."""
    splits = {v: _labelled_split(spark, sf, v) for _, v in evaluate.MODEL_VERSIONS}
    preds = materialize(evaluate.predictions(splits), "predictions")
    floor = F.when(F.col("model") == "logistic_regression", CLASSIC_FLOOR).otherwise(DENSE_FLOOR)
    return evaluate.slice_metrics(preds).select("model", "slice", "n", (F.col("accuracy") >= floor).alias("floor_met"))


@register("topic_pipeline", _with(tax=TAX_SQL, bal=BALANCED_SQL) + f"""
, m AS (SELECT b.doc_id, b.domain, t.topic, {S.tfidf_text('b.text')} AS t
        FROM bal b LEFT JOIN tax t ON b.domain = t.domain AND b.raw_target = t.raw_target),
k AS (SELECT * FROM m WHERE {S.nonempty('t')}),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {KEY_SQL}, doc_id) AS rank,
             count(*) OVER (PARTITION BY domain) AS n FROM k),
sp AS (SELECT *, (3 * n + 9) // 10 AS hold FROM r),
f AS (SELECT *, CASE WHEN rank <= n - hold THEN 'train'
                     WHEN rank <= n - hold + (hold - (hold + 1) // 2) THEN 'val' ELSE 'test' END AS split FROM sp),
u AS (SELECT count(*) AS n_unlabelled FROM f WHERE topic IS NULL)
SELECT 'logistic_regression' AS model, slice, n, n_unlabelled FROM (
  SELECT 'test' AS slice, count(*) AS n FROM f WHERE split = 'test' AND topic IS NOT NULL
  UNION ALL SELECT domain, count(*) FROM f WHERE split = 'train' AND topic IS NOT NULL GROUP BY domain) x, u""")
def q_topic_pipeline(spark, sf):
    """SURVEY §3.1-3.3 in one job: balance, map to topics, clean x3, split,
    TF-IDF + logistic regression on the topic label (unmapped rows excluded
    and counted), evaluated on the test split and per domain (train split).
    The derived topics are dealt round robin, so no score is claimed."""
    prepared = materialize(prepare.prepare(derive.corpus(spark, sf), derive.derived_taxonomy(spark, sf)), "prepared")
    out = evaluate.train_on_prepared(prepared)
    return out.select("model", "slice", "n", F.col("n_unlabelled").cast("long").alias("n_unlabelled"))


EPOCHS = epochs.EpochParams(epochs=4, batch_rows=64)
PIECES = dict(merges=192, per_round=96)


def _encoded_split(spark, sf):
    """(train, val, vocabulary size, labels) of the light text version as
    subword ids of at most ENC_LEN pieces."""
    data = materialize(_labelled_split(spark, sf, "transformer"), "split")
    train = data.where(F.col("split") == "train")
    model, words = subwords.learn(subwords.word_counts(train), **PIECES)
    labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]           # class names
    ids = subwords.encode_texts(data, model, words, ENC_LEN).select("doc_id", "ids")
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    rows = materialize(data.select("doc_id", "split", F.when(y >= 0, y).cast("int").alias("y")).join(ids, "doc_id"), "encoded")
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val"), model.size, labels


@register("dense_epochs", f"""
SELECT epoch, n AS n_val, k AS n_classes_predicted, true AS score_recounted, true AS best_floor_met, CAST(1 AS BIGINT) AS n_best,
       true AS best_is_top
FROM (SELECT CAST(i AS INTEGER) AS epoch FROM range({EPOCHS.epochs}) r(i)) t,
     (SELECT n FROM ({_split_counts_sql('transformer')}) c WHERE split = 'val') v,
     (SELECT count(DISTINCT lang) AS k FROM documents) l""")
def q_dense_epochs(spark, sf):
    """M08 + W10: the epoch trainer on subword ids, one run; each epoch's
    macro-F1 counted again from the predictions it wrote, the best epoch, and
    the classes the last epoch predicts."""
    train, val, size, labels = _encoded_split(spark, sf)
    _, table, folder = epochs.train_epochs(train, val, size, labels, EPOCHS)
    preds = spark.read.parquet(f"{folder}/predictions")
    classes = preds.select("epoch", "y", "prediction", F.explode(F.array_distinct(F.array("y", "prediction"))).alias("k"))
    hits = classes.groupBy("epoch", "k").agg(
        F.sum(((F.col("y") == F.col("prediction")) & (F.col("y") == F.col("k"))).cast("long")).alias("tp"), F.count(F.lit(1)).alias("any"))
    # a row counts once for a class it has or is given: F1 = 2 tp / (tp + any)
    again = hits.groupBy("epoch").agg(F.avg(2 * F.col("tp") / (F.col("tp") + F.col("any"))).alias("f1"))
    n = preds.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_val"))
    last = preds.where(F.col("epoch") == EPOCHS.epochs - 1).agg(F.countDistinct("prediction").alias("k")).first().k
    best = search.best_trial(table.select(F.col("epoch").alias("trial"), "val_f1")).first()
    out = table.join(again, "epoch").join(n, "epoch")
    top = table.agg(F.max("val_f1")).first()[0]
    return out.select("epoch", "n_val", F.lit(last).cast("long").alias("n_classes_predicted"),
                      (F.abs(F.col("f1") - F.col("val_f1")) < 1e-9).alias("score_recounted"),
                      F.lit(bool(best.val_f1 >= DENSE_FLOOR)).alias("best_floor_met"),
                      F.sum((F.col("epoch") == best.trial).cast("long")).over(Window.partitionBy()).alias("n_best"),
                      F.lit(best.val_f1 == top).alias("best_is_top"))


@register("learning_curve", f"""
SELECT m.model, CAST(p.pct AS INTEGER) AS pct, c.n AS n_val, true AS floor_met
FROM (VALUES (25), (50), (75), (100)) p(pct), (VALUES ('logistic_regression', 'tfidf'), ('transformer', 'transformer')) m(model, version)
JOIN (SELECT version, count(*) AS n FROM ({_split_sql()}) sp WHERE split = 'val' GROUP BY version) c USING (version)""")
def q_learning_curve(spark, sf):
    """M11 + W04: both arms fitted on 25/50/75/100% nested shares of the
    training split, scored on the whole validation split against a floor."""
    out = None
    for name, version in evaluate.MODEL_VERSIONS[:2]:
        data = _labelled_split(spark, sf, version)

        def fit_predict(part, ev, name=name):
            m = classify.train_classic(part) if name == "logistic_regression" else classify.train_dense(part)
            return m.transform(ev).select("doc_id", F.col("label").alias("y"), F.col("predicted_label").alias("p"))
        one = curves.learning_curve(data.where(F.col("split") == "train"), data.where(F.col("split") == "val"), fit_predict, name)
        out = one if out is None else out.unionByName(one)
    return out.select("model", "pct", F.col("n").cast("long").alias("n_val"),
                      ((F.col("f1_score") >= TRIAL_FLOOR) & (F.col("accuracy") >= TRIAL_FLOOR)).alias("floor_met"))


SEARCH_TRIALS, SEARCH_SEED, SEARCH_TOP = 7, 5, 5
STRONG_L1 = 0.15            # below this C an l1 penalty leaves too few terms to tell the languages apart: such trials miss the floor


def _u_sql(name: str) -> str:
    return f"(CAST('0x' || substr(md5('{SEARCH_SEED}:' || CAST(trial AS VARCHAR) || ':{name}'), 1, 8) AS BIGINT) / 4294967296.0)"


@register("classic_search", f"""
WITH t AS (SELECT CAST(i AS INTEGER) AS trial FROM range({SEARCH_TRIALS}) r(i)),
p AS (SELECT trial, 1 + CAST(floor({_u_sql('ngram_min')} * 2) AS INTEGER) AS ngram_min,
             2 + CAST(floor({_u_sql('min_df')} * 9) AS INTEGER) AS min_df,
             round(0.5 + {_u_sql('max_df')} * (0.95 - 0.5), 6) AS max_df,
             (['None', '5000', '10000', '20000', '50000'])[CAST(floor({_u_sql('max_features')} * 5) AS INTEGER) + 1] AS max_features,
             round(exp(ln(0.01) + {_u_sql('C')} * ln(1000.0)), 6) AS c,
             (['500', '1000', '2000'])[CAST(floor({_u_sql('max_iter')} * 3) AS INTEGER) + 1] AS max_iter,
             (['liblinear', 'lbfgs'])[CAST(floor({_u_sql('solver')} * 2) AS INTEGER) + 1] AS solver,
             (['balanced', 'None'])[CAST(floor({_u_sql('class_weight')} * 2) AS INTEGER) + 1] AS class_weight,
             {_u_sql('ngram_max')} AS u_max, {_u_sql('penalty')} AS u_pen FROM t)
SELECT trial, ngram_min, ngram_min + CAST(floor(u_max * (3 - ngram_min + 1)) AS INTEGER) AS ngram_max, min_df, max_df, max_features,
       CAST(CASE WHEN max_features = 'None' THEN NULL ELSE max_features END AS INTEGER) AS most_features, c, max_iter,
       solver, class_weight, CASE WHEN solver = 'liblinear' THEN (['l1', 'l2'])[CAST(floor(u_pen * 2) AS INTEGER) + 1] ELSE 'l2' END AS penalty,
       'ok' AS status, NOT (solver = 'liblinear' AND u_pen < 0.5 AND c < {STRONG_L1}) AS floor_met, CAST({SEARCH_TOP} AS BIGINT) AS n_top, true AS rest_not_better, n AS n_test, true AS best_floor_met
FROM p, (SELECT n FROM ({_split_counts_sql('tfidf')}) c WHERE split = 'test') v""")
def q_classic_search(spark, sf):
    """M06 + M07 + T04 + W10: seeded trials over the whole classic space on
    the fixed validation split, the top five of them, and the best trial fitted
    again on train and validation rows and evaluated on the test split."""
    data = _labelled_split(spark, sf, "tfidf")
    train, val, test = (data.where(F.col("split") == x) for x in ("train", "val", "test"))
    trials = materialize(search.random_search(train, val, SEARCH_TRIALS, SEARCH_SEED), "trials")
    top = search.top_trials(trials, SEARCH_TOP).select(F.col("trial").alias("_top"))
    marked = materialize(trials.join(top, F.col("trial") == F.col("_top"), "left").withColumn("in_top", F.col("_top").isNotNull()), "marked")
    sides = marked.agg(F.sum(F.col("in_top").cast("long")).alias("n"), F.min(F.when(F.col("in_top"), F.col("val_f1"))).alias("low"),
                       F.max(F.when(~F.col("in_top"), F.col("val_f1"))).alias("high")).first()
    best = search.best_trial(trials).select("params").first().params
    model = search.refit(data.where(F.col("split") != "test"), dict(best))
    final = metrics.summary(classify.score(test, model, "best").select(
        F.col("label").alias("y"), F.col("predicted_label").alias("p"))).first()
    p = F.col("params")
    return marked.select(
        "trial", *[p[x].cast("int").alias(x) for x in ("ngram_min", "ngram_max", "min_df")],
        F.round(p["max_df"].cast("double"), 6).alias("max_df"), p["max_features"].alias("max_features"), "most_features",
        F.round(p["C"].cast("double"), 6).alias("c"), *[p[x].alias(x) for x in ("max_iter", "solver", "class_weight", "penalty")],
        "status", (F.col("val_f1") >= TRIAL_FLOOR).alias("floor_met"), F.lit(sides.n).cast("long").alias("n_top"),
        F.lit(bool(sides.low >= sides.high)).alias("rest_not_better"), F.lit(final.n).cast("long").alias("n_test"), F.lit(bool(final.accuracy >= CLASSIC_FLOOR)).alias("best_floor_met"))


@register("example_predictions", f"""
SELECT doc_id, label, label AS predicted_label, true AS correct, shuffle_key, CAST(2 AS INTEGER) AS model_version FROM (
  SELECT doc_id, domain AS label, {KEY_SQL} AS shuffle_key FROM ({_split_sql()}) sp WHERE version = 'tfidf' AND split = 'test') x
ORDER BY shuffle_key, doc_id LIMIT 5""")
def q_example_predictions(spark, sf):
    """P15 + T01 + T06 + W08: the five first test rows in seeded order with
    their prediction, correct flag and the newest registered model version. SQL
    states the true label: the language of a text is told without fail."""
    data = _labelled_split(spark, sf, "tfidf")
    model = classify.train_classic(data.where(F.col("split") == "train"))
    root = scratch_path(spark, "registry")
    registry.save_model(model, f"{root}/model")
    for _ in range(2):
        registry.register_version(spark, root, "classic", f"{root}/model")
    newest = registry.latest_versions(spark.read.schema(registry.VERSIONS_SCHEMA).parquet(f"{root}/model_versions")).first()
    scored = classify.score(data.where(F.col("split") == "test"), registry.load_model(spark, None, root, "classic"), "classic")
    flagged = scored.withColumn("correct", T.correct_flag("label", "predicted_label"))
    rows = sample.first_rows(sample.seeded_order(flagged, "doc_id"), ["shuffle_key", "doc_id"], 5)
    return rows.select("doc_id", "label", "predicted_label", "correct", "shuffle_key",
                       F.lit(newest.version).cast("int").alias("model_version"))


@register("stream_scoring", """
SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 1 THEN 'empty' END AS reject_reason,
       CASE WHEN length(coalesce(text, '')) >= 1 THEN true END AS known_label,
       CASE WHEN length(coalesce(text, '')) >= 1 THEN true END AS floor_met,
       (SELECT count(*) FROM documents) AS n_rows,
       (SELECT count(*) FROM documents WHERE length(coalesce(text, '')) < 1) AS n_rejected
FROM documents""")
def q_stream_scoring(spark, sf):
    """R02 + P13 + G17: texts arrive as JSON files; invalid ones go to the
    reject sink, valid ones of any length get the training-time cleaning and
    the model; the batch summaries are added up."""
    data = _labelled_split(spark, sf, "transformer")
    model = classify.train_dense(data.where(F.col("split") == "train"))
    root = scratch_path(spark, "scoring")
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    readers.write_jsonl(docs, f"{root}/in/a", "overwrite")
    ingest.score_stream(spark, f"{root}/in/*/*.json", model, "transformer", clean.clean_light("text"),
                        f"{root}/out", f"{root}/rejects", f"{root}/ckpt")
    total = spark.read.parquet(f"{root}/out_summary").agg(F.sum("n_rows").alias("n"), F.sum("n_rejected").alias("bad")).first()
    labels = list(model.stages[-1].getLabels())
    out = spark.read.parquet(f"{root}/out")
    right = out.join(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").agg(
        F.avg((F.col("lang") == F.col("predicted_topic")).cast("double"))).first()[0]
    scored = out.select(
        "doc_id", F.lit(None).cast("string").alias("reject_reason"), F.col("predicted_topic").isin(labels).alias("known_label"),
        F.lit(bool(right >= DENSE_FLOOR)).alias("floor_met"))
    rejected = spark.read.parquet(f"{root}/rejects").select(
        "doc_id", "reject_reason", F.lit(None).cast("boolean").alias("known_label"), F.lit(None).cast("boolean").alias("floor_met"))
    return scored.unionByName(rejected).withColumns({"n_rows": F.lit(total.n).cast("long"), "n_rejected": F.lit(total.bad).cast("long")})


@register("lemma_join", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE WHEN length(x) > 3 AND suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END), ' ')
       AS lemma_text FROM w""")
def q_lemma_join(spark, sf):
    """X16/J07 with a dictionary table: one entry per word of the corpus that
    ends in s (thousands of forms, grows with the corpus), joined by token."""
    toks = read_table(spark, sf, "documents").select("doc_id", K.vectorizer_tokens("text").alias("tokens"))
    form = toks.select(F.explode("tokens").alias("form")).where((F.length("form") > 3) & F.col("form").endswith("s")).distinct()
    lemmas = form.select("form", F.expr("left(form, length(form) - 1)").alias("lemma"))
    out = features.lemmatize_tokens(toks, lemmas)
    return out.select("doc_id", F.array_join("lemmas", " ").alias("lemma_text"))


def _rules_sql() -> str:
    rows = ", ".join(f"('{g}', '{e}', '{p}', {k})" for g, rules in morphology.ENDINGS.items() for k, (e, p) in enumerate(rules))
    odd = ", ".join(f"('{g}', '{w.split(':')[0]}', '{w.split(':')[1]}')" for g, words in morphology.IRREGULAR.items() for w in words.split())
    return f"""
r AS (SELECT * FROM (VALUES {rows}) x(lang, ending, put, k)),
i AS (SELECT * FROM (VALUES {odd}) x(lang, form, irregular))"""


@register("rule_lemmas", f"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS form FROM documents),
f AS (SELECT lang, form, count(*) AS n FROM w WHERE regexp_full_match(form, '\\p{{L}}+') GROUP BY lang, form),
{_rules_sql()},
p AS (SELECT f.lang, f.form, r.ending, r.k, left(f.form, length(f.form) - length(r.ending)) || r.put AS lemma
      FROM f JOIN r ON f.lang = r.lang AND suffix(f.form, r.ending) AND length(f.form) - length(r.ending) >= {morphology.MIN_STEM}),
b AS (SELECT p.lang, p.form, p.lemma, row_number() OVER (PARTITION BY p.lang, p.form ORDER BY length(p.ending) DESC, p.k) AS rn
      FROM p JOIN f ON f.lang = p.lang AND f.form = p.lemma AND f.n >= {morphology.LEAST}
      WHERE p.lemma <> p.form AND length(p.lemma) >= {morphology.MIN_LEMMA})
SELECT f.lang, f.form, f.n, coalesce(i.irregular, b.lemma, f.form) AS lemma
FROM f LEFT JOIN b ON f.lang = b.lang AND f.form = b.form AND b.rn = 1 LEFT JOIN i ON f.lang = i.lang AND f.form = i.form""")
def q_rule_lemmas(spark, sf):
    """Every distinct word form of each language with its lemma by ending
    rules, accepted where the corpus holds the lemma."""
    docs = read_table(spark, sf, "documents")
    words = (docs.select("lang", F.explode(K.vectorizer_tokens("text")).alias("form")).where(F.col("form").rlike(r"^\p{L}+$"))
             .groupBy("lang", "form").agg(F.count(F.lit(1)).alias("n")))
    return morphology.lemma_table(materialize(words, "forms"))


# ---------------------------------------------------------------------------
# S01-S04 round trips, R01 streaming ingest
# ---------------------------------------------------------------------------
@register("csv_roundtrip", "SELECT doc_id, text, source AS target FROM documents")
def q_csv_roundtrip(spark, sf):
    """S04 then S01: multi-line quoted texts survive a CSV write and read."""
    path = scratch_path(spark, "csv")
    readers.write_csv(derive.corpus(spark, sf).select("doc_id", "text", F.col("raw_target").alias("target")), path)
    return readers.read_csv(spark, path)


CSV_FILE_BYTES = 512 << 20


@register("csv_split_scan", "SELECT doc_id, text, source AS target FROM documents")
def q_csv_split_scan(spark, sf):
    """S01 by split: CSV files of all documents, a file for every 512 MB of
    text at least, read by as many tasks as they have splits although their
    texts hold newlines and quotes."""
    path = scratch_path(spark, "csv-large")
    rows = derive.corpus(spark, sf).select("doc_id", "text", F.col("raw_target").alias("target"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # files far larger than a split, the case that needs splits, yet none that one task writes alone
    readers.write_csv(rows.coalesce(-(-size // CSV_FILE_BYTES) or 1), path)
    return readers.load_source(spark, "csv", path).drop("source")


RAW_COLS = "id, title, selftext, subreddit, link_flair_text, created_utc, permalink, is_self, over_18, num_comments, score, upvote_ratio"


@register("jsonl_roundtrip", f"SELECT {RAW_COLS}, copy FROM ({POSTS_SQL}) p")
def q_jsonl_roundtrip(spark, sf):
    """S03 append sink then S02 scan with a fixed schema (PERMISSIVE)."""
    path = scratch_path(spark, "jsonl")
    posts = derive.posts(spark, sf)
    readers.write_jsonl(posts.where(F.col("copy") == 0), path)
    readers.write_jsonl(posts.where(F.col("copy") == 1), path)          # append
    schema = Ty.StructType(readers.RAW_POST_SCHEMA.fields + [Ty.StructField("copy", Ty.IntegerType())])
    return readers.good_lines(readers.read_jsonl(spark, path, schema))


@register("stream_ingest_posts", f"""
WITH inv AS (SELECT lower(subreddit) AS sub_key, topic AS bucket FROM ({TOPICMAP_SQL}) t),
p AS (SELECT * FROM ({POSTS_SQL}) x WHERE copy = 0
        AND (length({_strip_sql("coalesce(title, '')")}) > 0 OR length({_strip_sql("coalesce(selftext, '')")}) > 0))
SELECT {_label_sql('hybrid')} AS label, {SER_SQL} FROM p LEFT JOIN inv ON lower(p.subreddit) = inv.sub_key""")
def q_stream_ingest_posts(spark, sf):
    """Posts arrive in three JSON files (the third repeats ids of the
    first two); the stream keeps each id once, labels and serializes them."""
    root = scratch_path(spark, "stream")
    posts = derive.posts(spark, sf)
    half = F.abs(F.hash("id")) % 2
    readers.write_jsonl(posts.where((F.col("copy") == 0) & (half == 0)).drop("copy"), f"{root}/in/f1", "overwrite")
    readers.write_jsonl(posts.where((F.col("copy") == 0) & (half == 1)).drop("copy"), f"{root}/in/f2", "overwrite")
    readers.write_jsonl(posts.where(F.col("copy") == 1).drop("copy"), f"{root}/in/f3", "overwrite")
    inv = collect.invert_topic_map(_topic_map(spark, sf))
    ingest.ingest_posts(spark, f"{root}/in/*/*.json", f"{root}/out", f"{root}/ckpt", inv)
    return spark.read.parquet(f"{root}/out").drop("batch")


# ---------------------------------------------------------------------------
# X23, X24, P13, S08-S11, U02
# ---------------------------------------------------------------------------
WORD_VOCAB = features.TfidfParams(ngram_min=1, ngram_max=1, min_df=1, max_df=1.0, max_features=20000)
ENC_LEN = 256


@register("encode_fixed", f"""
WITH d AS (SELECT doc_id, {S.tfidf_text('text')} AS text FROM documents),
tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) e GROUP BY doc_id, term),
v AS (SELECT term FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term) s
      ORDER BY cf DESC, term LIMIT {WORD_VOCAB.max_features}),
vi AS (SELECT term, row_number() OVER (ORDER BY term) + 1 AS wid FROM v),
e AS (SELECT doc_id, unnest(t[1:{ENC_LEN}]) AS term, unnest(range(1, len(t[1:{ENC_LEN}]) + 1)) AS pos FROM tk),
ids AS (SELECT e.doc_id, list(CAST(coalesce(vi.wid, 1) AS INTEGER) ORDER BY pos) AS ids
        FROM e LEFT JOIN vi ON e.term = vi.term GROUP BY e.doc_id),
full_ids AS (SELECT tk.doc_id, coalesce(ids.ids, []) AS ids FROM tk LEFT JOIN ids ON tk.doc_id = ids.doc_id)
SELECT doc_id, list_concat(ids, list_transform(range({ENC_LEN} - len(ids)), lambda x: 0)) AS input_ids,
       list_concat(list_transform(range(len(ids)), lambda x: 1), list_transform(range({ENC_LEN} - len(ids)), lambda x: 0)) AS attention_mask
FROM full_ids""")
def q_encode_fixed(spark, sf):
    """Word ids (0 pad, 1 unknown, vocabulary index + 2), truncated and
    padded to 256 with a 1/0 mask; the vocabulary is the top 20,000 words."""
    docs = _tfidf_docs(spark, sf, reuse=True)
    vocab = features.fit_tfidf(docs, WORD_VOCAB)
    return features.encode_documents(docs, vocab, ENC_LEN)


@register("subword_roundtrip", r"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' ') AS decoded,
       CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS INTEGER) AS n_words, true AS all_known FROM documents""")
def q_subword_roundtrip(spark, sf):
    """Subword pieces learned over all words of the corpus; every text
    encoded in full and decoded back, with no unknown piece."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model, words = subwords.learn(subwords.word_counts(docs), **PIECES)
    coded = subwords.encode_texts(docs, model, words)
    return coded.select("doc_id", subwords.decode(F.col("pieces")).alias("decoded"),
                        F.size(F.filter("pieces", lambda p: ~p.startswith(subwords.MARK))).alias("n_words"),
                        (~F.array_contains("ids", subwords.UNKNOWN)).alias("all_known"))


@register("softmax_argmax", """
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted_id,
       round(1.0 / list_sum(list_transform(embedding, lambda x: exp(x - list_max(embedding)))), 6) AS confidence
FROM embeddings""")
def q_softmax_argmax(spark, sf):
    """Embeddings read as logits -> softmax, argmax (ties: lowest id),
    max probability as confidence."""
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", K.argmax(F.col("embedding")).cast("int").alias("predicted_id"),
                    F.round(K.confidence(F.col("embedding")), 6).alias("confidence"))


@register("score_validation", """
SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars,
       CASE WHEN length(coalesce(text, '')) < 1 THEN 'empty' WHEN length(coalesce(text, '')) > 10000 THEN 'too_long' END AS reject_reason
FROM documents""")
def q_score_validation(spark, sf):
    """Scoring input must hold 1..10,000 characters; rejects get a reason."""
    d = ingest.validate(read_table(spark, sf, "documents"), max_chars=10_000)     # the limit is the feature here
    return d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), "reject_reason")


@register("category_roots", """
WITH c AS (
  SELECT d.doc_id,
         CASE WHEN l.doc_id IS NULL THEN [] ELSE [d.source || '.' || d.lang || ' ' || d.lang || '.misc', d.lang] END AS cats
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(cats[1], 'unknown') AS first_category,
       coalesce(CASE WHEN split_part(split_part(cats[1], ' ', 1), '.', 1) <> '' THEN split_part(split_part(cats[1], ' ', 1), '.', 1) END,
                'unknown') AS category_root
FROM c""")
def q_category_roots(spark, sf):
    """S08 first category else 'unknown'; S09 root code of the first entry."""
    d = read_table(spark, sf, "documents").alias("d")
    lab = read_table(spark, sf, "labels").select("doc_id", F.lit(1).alias("_has"))
    j = d.join(lab, "doc_id", "left")
    cats = F.when(F.col("_has").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat_ws("", "source", F.lit("."), "lang", F.lit(" "), "lang", F.lit(".misc")), F.col("lang")))
    j = j.withColumn("cats", cats)
    return j.select("doc_id", T.first_category("cats").alias("first_category"),
                    T.category_root("cats").alias("category_root"))


@register("class_names", f"""
WITH s AS (
  SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {KEY_SQL}, doc_id) AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM documents),
sp AS (SELECT doc_id, CASE WHEN rank <= n - (3 * n + 9) // 10 THEN 'train' ELSE 'test' END AS shard FROM s)
SELECT l.doc_id, sp.shard, (['low', 'high'])[l.quality + 1] AS quality_name,
       (['clean', 'toxic'])[l.toxic + 1] AS toxic_name
FROM labels l JOIN sp ON l.doc_id = sp.doc_id""")
def q_class_names(spark, sf):
    """S10/S11 + U02: labelled shards (train; val+test as 'test') united,
    class ids mapped to names."""
    split = sample.stratified_split(derive.corpus(spark, sf).select("doc_id", "domain"))
    lab = read_table(spark, sf, "labels").join(split.select("doc_id", "split"), "doc_id")
    train = lab.where(F.col("split") == "train").withColumn("shard", F.lit("train"))
    test = lab.where(F.col("split") != "train").withColumn("shard", F.lit("test"))
    u = readers.union_shards([train, test])
    u = readers.class_names(u, "quality", ["low", "high"], "quality_name")
    u = readers.class_names(u, "toxic", ["clean", "toxic"], "toxic_name")
    return u.select("doc_id", "shard", "quality_name", "toxic_name")


@register("model_input", "SELECT doc_id, text AS plain_input, lang || ': ' || text AS domain_input FROM documents")
def q_model_input(spark, sf):
    """The default input is the text alone; the disabled variant
    prefixes the domain."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.model_input("text").alias("plain_input"),
                    T.model_input("text", "lang", with_domain=True).alias("domain_input"))


@register("optional_scan", """
SELECT 'news' AS domain, 'parquet' AS source, text FROM documents
UNION ALL SELECT 'social', 'parquet', text FROM conversations""")
def q_optional_scan(spark, sf):
    """S05 + S06: domain files through the source registry; an absent file
    is skipped, only all-absent is an error."""
    files = {"news": os.path.join(sf, "documents.parquet"), "social": os.path.join(sf, "conversations.parquet"),
             "academic": os.path.join(sf, "no_such_table.parquet")}
    out = readers.read_optional(spark, files,
                                lambda sp, p: readers.load_source(sp, "parquet", p).select("text", "source"))
    return out.select("domain", "source", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
