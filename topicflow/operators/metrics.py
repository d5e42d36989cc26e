"""Classification metrics as aggregations.

Everything starts from one confusion-count table ``groupBy(by, y, p).count()``
(partial aggregation on the map side, so skewed labels cost nothing extra);
all metrics are derived from that small table. Predictions never reach the
driver.

Two macro-F1 flavours are kept apart:
  * ``union``   - labels in y ∪ p (training scripts, search);
  * ``present`` - labels in y only (evaluation); a label that is predicted
    but never true is left out of the mean.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """G10 sparse form: (by..., y, p, n)."""
    return preds.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def label_stats(conf: DataFrame, by: Sequence[str] = (), labels: str = "union") -> DataFrame:
    """Per (by..., label): support, predicted, tp, precision, recall, f1
    (zero on zero division). ``labels`` = 'union' or 'present'.

    One pass: every confusion cell (y, p, n) contributes a "true" row for y
    and a "predicted" row for p, summed by (group, label)."""
    by = list(by)
    is_tp = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), is_tp.alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")))
    e = conf.select(*by, F.explode(sides).alias("_e")).select(*by, "_e.*").where(F.col("label").isNotNull())
    s = e.groupBy(*by, "label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("support", "predicted", "tp")])
    if labels != "union":
        s = s.where(F.col("support") > 0)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    s = s.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return s.withColumn("f1", f1)


ALL = "_tf_all"


def _keyed(preds: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group on a constant key when no grouping is asked, so every later
    combine is an equi-join on the group key."""
    by = list(by)
    if by:
        return preds, by
    return preds.withColumn(ALL, F.lit(0)), [ALL]


def _unkey(df: DataFrame) -> DataFrame:
    return df.drop(ALL)


def summary(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """G06 + G07 + G08 per group: n, accuracy, f1_macro_union, f1_macro_present
    from one per-label pass and one per-group aggregation."""
    preds, by = _keyed(preds, by)
    st = label_stats(confusion_counts(preds, by, y, p), by, "union")
    out = st.groupBy(*by).agg(
        F.sum("support").cast("bigint").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro_union"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("f1_macro_present"))
    return _unkey(out)


def classification_report(preds: DataFrame, by: Sequence[str] = (), labels: str = "present",
                          y: str = "y", p: str = "p") -> DataFrame:
    """G09 long form: (by..., label, precision, recall, f1, support) for each
    label plus 'macro avg' and 'weighted avg', and an 'accuracy' row, or a
    'micro avg' row when the label set leaves out a predicted label.

    Everything comes from one per-label pass over the union of labels: the
    present labels are those with support, and predictions outside the label
    set are the predictions of labels without support."""
    preds, by = _keyed(preds, by)
    union = label_stats(confusion_counts(preds, by, y, p), by, "union")
    st = union if labels == "union" else union.where(F.col("support") > 0)
    rows = st.select(*by, "label", "precision", "recall", "f1", "support")
    sw = F.sum("support")
    avgs = st.groupBy(*by).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")) / sw).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / sw).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / sw).alias("w_f"), sw.cast("bigint").alias("sup"),
        F.sum("tp").alias("tp"), F.sum("predicted").alias("pred"))
    outside = union.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp_all"),
        F.sum(F.when(F.col("support") == 0, F.col("predicted")).otherwise(0)).alias("outside"))
    if labels == "union":
        outside = outside.withColumn("outside", F.lit(0))
    t = avgs.join(outside, by)
    macro = t.select(*by, F.lit("macro avg").alias("label"), F.col("m_p").alias("precision"),
                     F.col("m_r").alias("recall"), F.col("m_f").alias("f1"), F.col("sup").alias("support"))
    weighted = t.select(*by, F.lit("weighted avg").alias("label"), F.col("w_p").alias("precision"),
                        F.col("w_r").alias("recall"), F.col("w_f").alias("f1"), F.col("sup").alias("support"))
    mp = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    mr = F.when(F.col("sup") > 0, F.col("tp") / F.col("sup")).otherwise(0.0)
    mf = F.when(mp + mr > 0, 2 * mp * mr / (mp + mr)).otherwise(0.0)
    micro = (F.col("outside") > 0) | (F.col("sup") < F.col("n"))
    last = t.select(
        *by,
        F.when(micro, F.lit("micro avg")).otherwise(F.lit("accuracy")).alias("label"),
        F.when(micro, mp).alias("precision"), F.when(micro, mr).alias("recall"),
        F.when(micro, mf).otherwise(F.col("tp_all") / F.col("n")).alias("f1"),
        F.when(micro, F.col("sup")).otherwise(F.col("n")).cast("bigint").alias("support"))
    return _unkey(rows.unionByName(macro).unionByName(weighted).unionByName(last))


def confusion_grid(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """G10 + J06: dense label x label counts over the labels present in y,
    zero-filled; pairs whose prediction is outside the labels are dropped.
    The grid is generated by exploding the (small, per-group) label set, not
    by a cross join."""
    preds, by = _keyed(preds, by)
    conf = confusion_counts(preds, by, y, p)
    # the label set per group: bounded by the number of classes, not by rows
    labels = conf.groupBy(*by).agg(F.array_sort(F.collect_set("y")).alias("_labels"))
    grid = (labels.select(*by, F.explode("_labels").alias("y"), "_labels")
            .select(*by, "y", F.explode("_labels").alias("p")))
    return _unkey(grid.join(conf, [*by, "y", "p"], "left")
                  .select(*by, "y", "p", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def union_labels(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Distinct labels in y ∪ p."""
    return preds.select(F.col(y).alias("label")).union(preds.select(F.col(p).alias("label"))).distinct()


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c) per label (small table)."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()   # over the per-label table only (k rows)
    return c.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def score_matrix(scores: DataFrame, row: str, col: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Pivot on a known column list; missing cells -> 0."""
    return scores.groupBy(row).pivot(col, list(columns)).agg(F.first(value)).fillna(0.0, subset=list(columns))


def render_report(report: DataFrame, digits: int = 4) -> str:
    """Text rendering of a class report in the familiar column layout.
    One row per label reaches the driver; a report over very many labels is
    a table to be written, not a text to be rendered."""
    rows = report.collect()
    summary_labels = ("accuracy", "micro avg", "macro avg", "weighted avg")
    body = [r for r in rows if r.label not in summary_labels]
    tail = {r.label: r for r in rows if r.label in summary_labels}
    width = max([len(str(r.label)) for r in rows] + [len("weighted avg")])
    head = " " * width + "".join(f"{h:>10}" for h in ("precision", "recall", "f1-score", "support"))
    fmt = f"{{:>{width}}}" + "{:>10}" * 4

    def num(v):
        return "" if v is None else f"{v:.{digits}f}"

    lines = [head, ""]
    for r in sorted(body, key=lambda r: str(r.label)):
        lines.append(fmt.format(str(r.label), num(r.precision), num(r.recall), num(r.f1), r.support))
    lines.append("")
    for lab in summary_labels:
        if lab in tail:
            r = tail[lab]
            lines.append(fmt.format(lab, num(r.precision), num(r.recall), num(r.f1), r.support))
    return "\n".join(lines) + "\n"


def write_report(report: DataFrame, path: str, digits: int = 4) -> None:
    """S16 sink: the rendered report as one text file."""
    spark = report.sparkSession
    spark.createDataFrame([(render_report(report, digits).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
