"""Linear text classifier whose weights are a table (M02, M05 without a bound
on the vocabulary).

A fitted MLlib model keeps vocabulary and weights on the driver, which bounds
its features. Here terms are never numbered: the vocabulary (term, df, idf) and
the weights (term, one weight per class) are written tables, documents are
their long form (doc, term, x), and every product of documents and weights is a
join on the term and a sum. A term that very many documents hold is split: its
rows are dealt to ``parts`` copies of its weights by a hash of the document.

Fitting minimises the reference's multinomial objective, sum(w_i loss_i) +
|b|^2 / (2 C), by conjugate gradients with a diagonal preconditioner; a round
joins the long form twice (gradient, and the direction's scores, along which
the step is found from sums). The driver holds one number per class and round.

Edge cases: documents without a known term are scored by the intercepts; terms
unseen in training are ignored; rows without a label are left out of the fit;
equal scores go to the first class; no labelled rows are an error.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import softmax
from .common import materialize
from .features import TfidfParams, _bound, corpus_term_stats, term_frequencies, with_terms

SPLIT_ROWS = 1_000_000             # documents of a term that meet one copy of its weights
STEPS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.125, 0.06, 0.03, 0.01, 0.003, 0.001)


@dataclass
class TableModel:
    vocab: DataFrame               # (term, df, idf, parts)
    weights: DataFrame             # (term, w array<double>)
    intercepts: list[float]
    labels: list[str]
    params: TfidfParams


def vocabulary(docs: DataFrame, params: TfidfParams, id_col: str = "doc_id", text_col: str = "text", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Written (term, df, idf, parts) by the df bounds alone."""
    n = docs.count()
    stats = corpus_term_stats(docs, params, id_col, text_col)
    kept = stats.where((F.col("df") >= _bound(params.min_df, n)) & (F.col("df") <= _bound(params.max_df, n)))
    idf = F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0
    return materialize(kept.select("term", "df", idf.alias("idf"), F.ceil(F.col("df") / split_rows).cast("int").alias("parts")), "term-vocabulary")


def long_form(docs: DataFrame, vocab: DataFrame, params: TfidfParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written (doc, term, part, x): L2-normalised tf-idf; ``part`` tells which
    copy of a split term's weights the row meets."""
    tf = term_frequencies(with_terms(docs, id_col, text_col, 1, 1), id_col, ngrams=(params.ngram_min, params.ngram_max))
    copies = vocab.select("term", "idf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hot = vocab.where("parts > 1").select("term", F.col("parts").alias("many"))
    dealt = tf.join(hot, "term", "left").withColumn("part", F.expr(f"cast(pmod(xxhash64({id_col}), coalesce(many, 1)) as int)"))
    raw = dealt.join(copies.select("term", "part", "idf"), ["term", "part"]).select(
        F.col(id_col).alias("doc"), "term", "part", (F.col("tf") * F.col("idf")).alias("x"))
    raw = materialize(raw, "long-raw")
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return materialize(raw.join(norm, "doc").select("doc", "term", "part", (F.col("x") / F.col("norm")).alias("x")), "long")


def _copies(weights: DataFrame, vocab: DataFrame) -> DataFrame:
    """Weights with a row per copy of split terms."""
    return (weights.join(vocab.select("term", "parts"), "term")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))


def products(long: DataFrame, weights: DataFrame, vocab: DataFrame, k: int, col: str = "w", out: str = "z") -> DataFrame:
    """(doc, out): the documents' sums of x times an array column."""
    met = long.join(_copies(weights.select("term", F.col(col).alias("_w")), vocab), ["term", "part"])
    sums = met.groupBy("doc").agg(*[F.sum(F.col("x") * F.get("_w", F.lit(i))).alias(f"s{i}") for i in range(k)])
    return sums.select("doc", F.array(*[F.col(f"s{i}") for i in range(k)]).alias(out))


def scores(docs: DataFrame, model: TableModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, scores, predicted_label) for every row's id."""
    k = len(model.labels)
    z = products(long_form(docs, model.vocab, model.params, id_col, text_col), model.weights, model.vocab, k)
    b = F.array(*[F.lit(float(v)) for v in model.intercepts])
    names = F.array(*[F.lit(x) for x in model.labels])
    full = docs.select(F.col(id_col).alias("doc")).join(z, "doc", "left").select(
        F.col("doc").alias(id_col), F.when(F.col("z").isNull(), b).otherwise(F.zip_with("z", b, lambda x, y: x + y)).alias("scores"))
    return full.withColumn("predicted_label", F.get(names, (F.array_position("scores", F.array_max("scores")) - 1).cast("int")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _plus(a: str, b: str, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + t * y)


def _loss(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.log(F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)) - F.get(z, F.col("y"))


def fit_table(docs: DataFrame, labels: list[str], C: float = 0.9074963597476341, params: TfidfParams = TfidfParams(max_features=None),
              rounds: int = 12, tol: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
              weight_col: str | None = None, split_rows: int = SPLIT_ROWS) -> tuple[TableModel, list[float]]:
    """(model, objective after each round). ``labels`` are the class names."""
    k, lam = len(labels), 1.0 / C
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    rows = docs.where(F.col(label_col).isin(*labels))
    vocab = vocabulary(rows, params, id_col, text_col, split_rows)
    long = long_form(rows, vocab, params, id_col, text_col)
    zero = F.array(*[F.lit(0.0)] * k)
    state = materialize(rows.select(F.col(id_col).alias("doc"), at.cast("int").alias("y"),
                                    (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("weight"), zero.alias("z")), "scores")
    if state.isEmpty():
        raise ValueError("no labelled rows to fit on")
    weights = materialize(vocab.select("term", zero.alias("w"), zero.alias("d"), zero.alias("g")), "weights")
    b, b_dir, b_old, before, start, history = [0.0] * k, [0.0] * k, [0.0] * k, None, 0.0, []
    for _ in range(rounds):
        p = softmax(F.col("z"))
        resid = state.select("doc", F.transform(p, lambda v, i: F.col("weight") * (v - F.when(i == F.col("y"), 1.0).otherwise(0.0))).alias("r"),
                             F.transform(p, lambda v: F.col("weight") * v * (1 - v)).alias("h"))
        resid = materialize(resid, "residuals")
        met = long.join(resid, "doc")
        sums = met.groupBy("term").agg(*[F.sum(F.col("x") * F.get("r", F.lit(i))).alias(f"g{i}") for i in range(k)],
                                       *[F.sum(F.col("x") * F.col("x") * F.get("h", F.lit(i))).alias(f"h{i}") for i in range(k)])
        new = sums.select("term", F.array(*[F.col(f"g{i}") for i in range(k)]).alias("gn"), F.array(*[F.col(f"h{i}") for i in range(k)]).alias("hn"))
        cur = weights.join(new, "term").select(
            "term", "w", "d", "g", F.zip_with("gn", "w", lambda x, w: x + lam * w).alias("gn"), F.transform("hn", lambda h: 1 / (h + lam)).alias("m"))
        cur = materialize(cur, "gradient")
        bg, bh = ([float(v) for v in resid.agg(*[F.sum(F.get(c, F.lit(i))) for i in range(k)]).first()] for c in ("r", "h"))
        bm = [1 / max(h, 1e-9) for h in bh]
        scaled = F.zip_with("m", "gn", lambda m, g: m * g)
        s = cur.agg(F.sum(_dot(scaled, F.col("gn"))).alias("now"), F.sum(_dot(scaled, F.col("g"))).alias("cross")).first()
        now = float(s["now"] or 0.0) + sum(m * g * g for m, g in zip(bm, bg))
        start = now if before is None else start
        if now <= tol * tol * start:
            break
        cross = float(s["cross"] or 0.0) + sum(m * g * o for m, g, o in zip(bm, bg, b_old))
        beta = max(0.0, (now - cross) / before) if before else 0.0
        cur = materialize(cur.select("term", "w", F.zip_with(scaled, "d", lambda a, d: beta * d - a).alias("d"), F.col("gn").alias("g")), "direction")
        b_dir = [beta * d - m * g for d, m, g in zip(b_dir, bm, bg)]
        b_old, before = bg, now
        ups = products(long, cur, vocab, k, "d", "dz")
        moved = state.join(ups, "doc", "left").select("doc", "y", "weight", "z", F.zip_with(
            F.coalesce("dz", zero), F.array(*[F.lit(v) for v in b_dir]), lambda x, y: x + y).alias("dz"))
        moved = materialize(moved, "moved")
        line = moved.agg(*[F.sum(F.col("weight") * _loss(_plus("z", "dz", t))) for t in (0.0, *STEPS)]).first()
        size = cur.agg(F.sum(_dot(F.col("w"), F.col("w"))), F.sum(_dot(F.col("w"), F.col("d"))), F.sum(_dot(F.col("d"), F.col("d")))).first()
        value = [float(v) + lam / 2 * (size[0] + 2 * t * size[1] + t * t * size[2]) for v, t in zip(line, (0.0, *STEPS))]
        best = min(range(len(value)), key=lambda i: value[i])
        t = (0.0, *STEPS)[best]
        history.append(value[best])
        if t == 0.0:
            break
        weights = materialize(cur.select("term", _plus("w", "d", t).alias("w"), "d", "g"), "weights")
        state = materialize(moved.select("doc", "y", "weight", _plus("z", "dz", t).alias("z")), "scores")
        b = [x + t * d for x, d in zip(b, b_dir)]
    return TableModel(vocab, weights.select("term", "w"), b, labels, params), history


def from_vector_model(vocab: DataFrame, coefficients, intercepts, labels: list[str], params: TfidfParams) -> TableModel:
    """The table form of a bounded model: ``vocab`` (term, index, df, idf)."""
    spark = vocab.sparkSession
    rows = vocab.select("term", "index").collect()                                  # the model: max_features rows
    weights = spark.createDataFrame([(r["term"], [float(v) for v in coefficients[:, r["index"]]]) for r in rows], "term string, w array<double>")
    return TableModel(vocab.select("term", "df", "idf", F.lit(1).alias("parts")), weights, [float(v) for v in intercepts], labels, params)
