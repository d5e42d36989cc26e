"""Metric operators against the fixture facts and the published report."""
from pyspark.sql import functions as F

from topicflow.operators import metrics
from topicflow.sources import derive

SF001 = "/root/testdata/sf0.01"


def test_fixture_predictor_facts(spark):
    p = derive.predictions(spark, SF001)
    m = metrics.summary(p).first()
    assert m.n == 1000
    assert round(m.accuracy, 3) == 0.758
    assert round(m.f1_macro_union, 6) == 0.592724
    assert round(m.f1_macro_present, 6) == 0.740905
    assert m.f1_macro_union <= m.f1_macro_present     # differ only through the never-true 'xx'


def test_confusion_sums_to_rows(spark):
    p = derive.predictions(spark, SF001)
    c = metrics.confusion_counts(p)
    assert c.agg(F.sum("n")).first()[0] == 1000
    g = metrics.confusion_grid(p)
    assert g.count() == 16                        # 4 present labels squared, 'xx' dropped
    assert g.agg(F.sum("n")).first()[0] == 1000 - p.where(F.col("p") == "xx").count()


def test_report_has_micro_row_when_prediction_outside_labels(spark):
    p = derive.predictions(spark, SF001)
    labels = {r.label for r in metrics.classification_report(p).collect()}
    assert "micro avg" in labels and "accuracy" not in labels
    p2 = p.where(F.col("p") != "xx")
    labels2 = {r.label for r in metrics.classification_report(p2).collect()}
    assert "accuracy" in labels2


# Published per-class validation report (precision, recall, f1, support).
PUBLISHED = [
    (.6786, .6552, .6667, 58), (.6250, .6000, .6122, 25), (.7097, .6197, .6617, 71), (.5294, .4615, .4932, 39),
    (0, 0, 0, 2), (.3636, .5714, .4444, 7), (.2143, .1667, .1875, 18), (.4444, .8571, .5854, 14),
    (.7000, .7778, .7368, 9), (.3636, .5000, .4211, 8), (.6909, .7917, .7379, 48), (.9130, .8750, .8936, 24),
    (.8415, .7667, .8023, 90), (.4750, .6786, .5588, 28), (.8125, .5909, .6842, 22), (.9000, .7500, .8182, 12),
    (.6667, .4000, .5000, 5), (.8438, .7941, .8182, 34), (.6765, .7931, .7302, 29), (.8261, .7600, .7917, 25),
]


def _rebuild_predictions():
    """Rows (y, p) with the published tp / support / predicted counts."""
    tp = [round(r * n) for (_, r, _, n) in PUBLISHED]
    pred = [round(t / p) if p > 0 else 0 for t, (p, _, _, _) in zip(tp, PUBLISHED)]
    fn = [n - t for t, (_, _, _, n) in zip(tp, PUBLISHED)]
    fp = [q - t for q, t in zip(pred, tp)]
    # a class with precision 0 has an unknown prediction count; with every
    # prediction inside the 20 labels, errors balance: sum(fn) == sum(fp)
    zero = [c for c, (p, _, _, _) in enumerate(PUBLISHED) if p == 0]
    fp[zero[0]] += sum(fn) - sum(fp)
    assert sum(fn) == sum(fp) and fp[zero[0]] >= 0
    rows = []
    for c, t in enumerate(tp):
        rows += [(c, c)] * t
    fn_slots = [c for c, k in enumerate(fn) for _ in range(k)]
    fp_slots = [c for c, k in enumerate(fp) for _ in range(k)]
    # pair errors so that no pair is (c, c)
    fp_slots = fp_slots[len(fp_slots) // 2:] + fp_slots[:len(fp_slots) // 2]
    for a, b in zip(fn_slots, fp_slots):
        assert a != b
        rows.append((a, b))
    return rows


def test_published_report_golden(spark):
    rows = _rebuild_predictions()
    df = spark.createDataFrame([(f"t{y:02d}", f"t{p:02d}") for y, p in rows], "y string, p string")
    rep = {r.label: r for r in metrics.classification_report(df, labels="present").collect()}
    assert round(rep["macro avg"].f1, 4) == 0.6072
    assert round(rep["accuracy"].f1, 4) == 0.6778
    assert rep["accuracy"].support == 568
    for c, (p, r, f, n) in enumerate(PUBLISHED):
        row = rep[f"t{c:02d}"]
        assert (round(row.precision, 4), round(row.recall, 4), round(row.f1, 4), row.support) == (p, r, f, n)


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    w = {r.label: r.weight for r in metrics.class_weights(df).collect()}
    assert abs(w["a"] - 8 / (2 * 6)) < 1e-12 and abs(w["b"] - 8 / (2 * 2)) < 1e-12
