"""Epoch trainer for the dense arm (M08): embedding bag and softmax over encoded
ids, trained by mini-batches with AdamW.

* Batches: every row falls into one of ``ceil(n / batch_rows)`` batches by a
  hash of its id. Each epoch visits the batches in another seeded order, in
  which its rows are written, a folder per run of batches of RUN_ROWS rows.
* A run is one Spark job whose task gets the state, makes an AdamW step per
  batch (linear warm-up and decay, gradient clipping, decoupled weight decay)
  and returns the state: steps follow each other, so a job per step would only
  wait for jobs. A batch too large for a run is a job of its own: every task
  returns the gradient of its rows (the embedding rows that occur, and the
  softmax part), merged in a tree of tasks, and the driver makes the step.
* After each epoch the validation rows are scored, the predictions are written,
  and macro-F1 is counted from them. The state of an epoch (parameters, both
  moments, the step) is written too: a later run resumes from it and gets the
  same weights. The best epoch of the one run is kept (ties: the earlier).

The driver holds the parameters (vocabulary x width, both parameters), never
rows, and a task a run's rows. A lost task recomputes its rows' gradient; the result doesn't depend on
how rows are dealt to tasks, up to the rounding of sums.

Edge cases: rows without ids have the bag 0 and are trained on the bias alone;
rows without a label are left out; ids outside the vocabulary are an error; an
empty table is an error.
"""
from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import scratch_path
from .common import materialize
from .metrics import summary


RUN_ROWS = 16_384                        # rows of a job, as whole batches
SCORE_ROWS = 256                         # rows whose embeddings are held at once
DENSE_CELLS = 1 << 20                    # ids x rows of a batch that are counted in a full matrix


@dataclass(frozen=True)
class EpochParams:
    width: int = 32
    epochs: int = 4                      # the reference's number of epochs
    batch_rows: int = 64                 # rows of a step, all tasks together
    learning_rate: float = 0.05
    weight_decay: float = 0.04508605470151595
    warmup_ratio: float = 0.13804941471382906
    clip: float = 1.0
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    seed: int = 42


@dataclass
class State:
    """Parameters by name, AdamW moments, steps done."""
    weights: dict[str, np.ndarray]
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    step: int = 0

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, step=self.step, **{f"{k}_{n}": a for k, part in (("w", self.weights), ("m", self.m), ("v", self.v))
                                         for n, a in part.items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> "State":
        with np.load(io.BytesIO(data)) as z:
            parts = [{n: z[f"{k}_{n}"] for n in ("embed", "out", "bias")} for k in "wmv"]
            return cls(*parts, int(z["step"]))


def fresh_state(vocab: int, classes: int, params: EpochParams) -> State:
    draw = np.random.default_rng(params.seed)
    weights = {"embed": draw.normal(0, 0.1, (vocab, params.width)), "out": draw.normal(0, 0.1, (params.width, classes)),
               "bias": np.zeros(classes)}
    return State(weights, *({n: np.zeros_like(a) for n, a in weights.items()} for _ in range(2)))


def bags(ids: pa.Array, embed: np.ndarray):
    """(mean embedding of each row, flat ids, their row, their share)."""
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    part = 1.0 / np.maximum(size, 1)[row]
    h = np.zeros((len(size), embed.shape[1]))
    full = np.flatnonzero(size)
    if len(full):
        h[full] = np.add.reduceat(embed[flat] * part[:, None], (offsets[:-1] - offsets[0])[full], axis=0)
    return h, flat, row, part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(weights: dict, ids: pa.Array) -> np.ndarray:
    """Class probabilities of each row, SCORE_ROWS rows at a time."""
    parts = [softmax(bags(ids.slice(k, SCORE_ROWS), weights["embed"])[0] @ weights["out"] + weights["bias"]) for k in range(0, len(ids), SCORE_ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, len(weights["bias"])))


def gradient(weights: dict, ids: pa.Array, y: np.ndarray):
    """Summed cross-entropy and its gradient over rows: (loss, embedding ids,
    their gradient rows, out, bias)."""
    offsets = ids.offsets.to_numpy()
    flat, size = ids.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64), np.diff(offsets)
    used, at = np.unique(flat, return_inverse=True)
    few = len(used) * len(size) <= DENSE_CELLS
    if few:                              # how often each row has each id, as a matrix
        held = np.bincount(np.repeat(np.arange(len(size)), size) * len(used) + at, minlength=len(size) * len(used)).reshape(len(size), len(used))
        held = held / np.maximum(size, 1)[:, None]
        h = held @ weights["embed"][used]
    else:
        h, _, row, part = bags(ids, weights["embed"])
    p = softmax(h @ weights["out"] + weights["bias"])
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    d = p
    d[np.arange(len(y)), y] -= 1.0
    back = d @ weights["out"].T
    if few:
        rows = held.T @ back
    else:
        rows = np.zeros((len(used), h.shape[1]))
        np.add.at(rows, at, back[row] * part[:, None])
    return loss, used, rows, h.T @ d, d.sum(axis=0)


GRADIENT = "loss double, n long, used binary, rows binary, out binary, bias binary"


def merge(parts) -> tuple:
    """Sum of (loss, n, used, rows, out, bias)."""
    parts = list(parts)
    used, at = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    rows = np.zeros((len(used), parts[0][3].shape[1]))
    np.add.at(rows, at, np.concatenate([p[3] for p in parts]))
    return sum(p[0] for p in parts), sum(p[1] for p in parts), used, rows, sum(p[4] for p in parts), sum(p[5] for p in parts)


def _sent(part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([float(part[0])]), pa.array([int(part[1])], pa.int64()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in part[2:])],
        [x.split()[0] for x in GRADIENT.split(", ")])


def _received(row, width: int, classes: int) -> tuple:
    return (row[0], row[1], np.frombuffer(row[2], np.int64), np.frombuffer(row[3]).reshape(-1, width),
            np.frombuffer(row[4]).reshape(width, classes), np.frombuffer(row[5]))


def batch_gradient(rows: DataFrame, weights: dict, fan_in: int = 32) -> tuple:
    """Gradient over the rows (``ids``, ``y``), merged in a tree."""
    width, classes = weights["out"].shape

    def map_rows(batches):
        parts = [(*gradient(weights, b.column(0), b.column(1).to_numpy(zero_copy_only=False)), b.num_rows) for b in batches if b.num_rows]
        if parts:
            yield _sent(merge([(p[0], p[5], *p[1:5]) for p in parts]))

    def map_parts(batches):
        parts = [_received([c[i].as_py() for c in b.columns], width, classes) for b in batches for i in range(b.num_rows)]
        if parts:
            yield _sent(merge(parts))
    sums = rows.select("ids", "y").mapInArrow(map_rows, GRADIENT)
    n = sums.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        sums = sums.repartition(n).mapInArrow(map_parts, GRADIENT)
    return merge(_received(r, width, classes) for r in sums.collect())            # at most fan_in sums


def rate_at(step: int, total: int, params: EpochParams) -> float:
    """Linear warm-up, then linear decay to 0."""
    warm = math.ceil(total * params.warmup_ratio)
    if step < warm:
        return params.learning_rate * step / max(1, warm)
    return params.learning_rate * max(0.0, (total - step) / max(1, total - warm))


def adamw(state: State, loss_n: int, part: tuple, total: int, params: EpochParams) -> None:
    """One step with the mean gradient; weight decay is decoupled and spares
    the bias."""
    embed = np.zeros_like(state.weights["embed"])
    embed[part[2]] = part[3]
    grads = {"embed": embed / loss_n, "out": part[4] / loss_n, "bias": part[5] / loss_n}
    norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    scale = min(1.0, params.clip / (norm + 1e-6))
    rate = rate_at(state.step, total, params)
    state.step += 1
    for name, g in grads.items():
        g = g * scale
        state.m[name] = params.beta1 * state.m[name] + (1 - params.beta1) * g
        state.v[name] = params.beta2 * state.v[name] + (1 - params.beta2) * g * g
        m = state.m[name] / (1 - params.beta1 ** state.step)
        v = state.v[name] / (1 - params.beta2 ** state.step)
        if name != "bias":
            state.weights[name] = state.weights[name] * (1 - rate * params.weight_decay)
        state.weights[name] = state.weights[name] - rate * m / (np.sqrt(v) + params.eps)


RUN = "state binary, loss double, n long, rate double"


def run_steps(rows: DataFrame, state: State, total: int, params: EpochParams) -> tuple:
    """(state, summed loss, rows, last rate) after a step for each ``pos`` of
    the rows (``pos``, ``doc_id``, ``ids``, ``y``), in their order, by one task."""
    def steps(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        now, loss, seen, rate = state, 0.0, 0, 0.0
        table = pa.Table.from_batches(batches).sort_by([("pos", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        pos, ids, y = (table.column(c).chunk(0) for c in ("pos", "ids", "y"))
        cuts = [0, *(np.flatnonzero(np.diff(pos.to_numpy())) + 1).tolist(), len(pos)]
        for a, b in zip(cuts, cuts[1:]):
            part = gradient(now.weights, ids.slice(a, b - a), y.slice(a, b - a).to_numpy())
            rate = rate_at(now.step, total, params)
            adamw(now, b - a, (part[0], b - a, *part[1:]), total, params)
            loss, seen = loss + part[0], seen + b - a
        yield pa.RecordBatch.from_arrays([pa.array([now.packed()], pa.binary()), pa.array([float(loss)]), pa.array([seen], pa.int64()), pa.array([float(rate)])],
                                         [x.split()[0] for x in RUN.split(", ")])
    got = rows.select("pos", "doc_id", "ids", "y").coalesce(1).mapInArrow(steps, RUN).first()
    return State.unpacked(bytes(got["state"])), got["loss"], got["n"], got["rate"]


def deal(rows: DataFrame, order: list[int], steps: int, path: str) -> int:
    """Writes the rows (``batch``) in an epoch's order of batches, a folder per
    run of ``steps`` batches; the number of runs."""
    place = rows.sparkSession.createDataFrame([(int(b), i) for i, b in enumerate(order)], "batch int, pos int")     # a number per step
    dealt = rows.join(F.broadcast(place), "batch").withColumn("run", F.floor(F.col("pos") / steps).cast("int"))
    dealt.repartition("run").write.mode("overwrite").partitionBy("run").parquet(path)
    return -(-len(order) // steps)


class EpochModel:
    """Scores encoded rows with the weights of one epoch."""

    def __init__(self, weights: dict, labels: list[str]):
        self.weights, self.labels = weights, labels

    def transform(self, rows: DataFrame, ids_col: str = "ids") -> DataFrame:
        """Adds ``prediction`` (class number), ``predicted_label`` and
        ``confidence``."""
        weights, labels = self.weights, self.labels
        at = rows.columns.index(ids_col)

        def run(batches):
            for b in batches:
                p = probabilities(weights, b.column(at))
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32()), pa.array([labels[k] for k in best], pa.string()),
                                                  pa.array(p.max(axis=1) if len(p) else [], pa.float64())],
                                                 [*b.schema.names, "prediction", "predicted_label", "confidence"])
        schema = Ty.StructType([*rows.schema.fields, Ty.StructField("prediction", Ty.IntegerType()),
                                Ty.StructField("predicted_label", Ty.StringType()), Ty.StructField("confidence", Ty.DoubleType())])
        return rows.mapInArrow(run, schema)


EPOCHS = "epoch int, step int, loss double, rate double, val_f1 double, val_accuracy double"


def write_state(spark: SparkSession, folder: str, epoch: int, state: State, report: tuple) -> None:
    row = (epoch, state.step, *report, bytearray(state.packed()))
    spark.createDataFrame([row], EPOCHS + ", state binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")


def written_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The epoch table of a run, as written."""
    return spark.read.schema(EPOCHS.replace("epoch int, ", "") + ", state binary, epoch int").parquet(f"{folder}/state")


def train_epochs(train: DataFrame, val: DataFrame, vocab: int, labels: list[str], params: EpochParams = EpochParams(),
                 folder: str | None = None, resume: bool = False, stop_after: int | None = None):
    """(model of the best epoch, epoch table, folder). ``train`` and ``val``
    hold ``doc_id``, ``ids`` (array<int>, below ``vocab``) and ``y`` (class
    number); ``folder/predictions/epoch=k`` gets (doc_id, y, prediction) of the
    validation rows. ``resume`` continues after the last epoch written in
    ``folder``; ``stop_after`` ends a run early, as a lost driver would."""
    spark = train.sparkSession
    folder = folder or scratch_path(spark, "epochs")
    rows = train.where("y is not null").select("doc_id", "ids", F.col("y").cast("long").alias("y"))
    n = rows.count()
    if not n:
        raise ValueError("no labelled rows to train on")
    batches = -(-n // params.batch_rows)
    rows.withColumn("batch", F.expr(f"cast(pmod(xxhash64(doc_id, {params.seed}), {batches}) as int)")).write.mode("overwrite").parquet(f"{folder}/rows")
    table, steps = spark.read.parquet(f"{folder}/rows"), max(1, RUN_ROWS // params.batch_rows)
    row = Ty.StructType([*table.schema.fields, Ty.StructField("pos", Ty.IntegerType())])
    present = sorted(r[0] for r in table.select("batch").distinct().collect())              # one number per step of an epoch
    scored_rows = materialize(val.where("y is not null").select("doc_id", "ids", F.col("y").cast("int").alias("y")), "validation")
    total = len(present) * params.epochs
    state, first = fresh_state(vocab, len(labels), params), 0
    if resume:
        last = written_epochs(spark, folder).orderBy(F.desc("epoch")).first()
        state, first = State.unpacked(bytes(last["state"])), last["epoch"] + 1
    for epoch in range(first, params.epochs):
        order = np.random.default_rng((params.seed, epoch)).permutation(present)
        loss, seen = 0.0, 0
        for run in range(deal(table, order.tolist(), steps, f"{folder}/runs/epoch={epoch}")):
            part = spark.read.schema(row).parquet(f"{folder}/runs/epoch={epoch}/run={run}")
            if steps > 1:
                state, lost, n_rows, rate = run_steps(part, state, total, params)
            else:
                whole = batch_gradient(part, state.weights)
                rate = rate_at(state.step, total, params)
                adamw(state, whole[1], whole, total, params)
                lost, n_rows = whole[:2]
            loss, seen = loss + lost, seen + n_rows
        scored = EpochModel(state.weights, labels).transform(scored_rows).select("doc_id", "y", "prediction")
        scored.write.mode("overwrite").parquet(f"{folder}/predictions/epoch={epoch}")
        m = summary(spark.read.parquet(f"{folder}/predictions/epoch={epoch}").select(
            F.col("y"), F.col("prediction").alias("p"))).first()
        report = (loss / seen, rate, float(m.f1_macro_union), float(m.accuracy)) if m is not None and m.n else (loss / seen, rate, None, None)
        write_state(spark, folder, epoch, state, report)
        if stop_after is not None and epoch + 1 >= stop_after:
            break
    table = written_epochs(spark, folder)
    best = table.groupBy().agg(F.max_by("state", F.struct(F.coalesce("val_f1", F.lit(0.0)), -F.col("epoch"))).alias("s")).first()["s"]
    return EpochModel(State.unpacked(bytes(best)).weights, labels), table.drop("state"), folder

