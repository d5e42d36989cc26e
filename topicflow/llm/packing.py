"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Piece lengths are whole numbers up to the capacity, so the whole corpus is
described by one count per length. The driver runs best-fit decreasing on
these counts (4096 numbers, whatever the corpus): a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time, and a
run of equal lengths is placed at once, which gives the bins that placing the
documents one by one would give. The result is a table of placements
(length, ranks, bins, offset); every piece then finds its bin from its rank
among the pieces of its length. Ranks come from counts per (length, hash
bucket), so a length that a third of all pieces share is spread over buckets.

Edge cases: null text is empty and gives the end id alone; texts longer than
the capacity are cut into full pieces and a rest; a null doc_id is an id like
any other; repeated rows are packed each; an empty table gives an empty
result; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

CAPACITY = 4096
SLICE = 4 << 20            # bytes of text handled at once
BATCH_ROWS = 2000          # texts in one Arrow batch
END_ID = 1


class Tightest:
    """Segment tree over capacities 0..cap: the least one >= x that is set."""

    def __init__(self, cap: int):
        self.size = 1 << cap.bit_length()
        self.on = [False] * (2 * self.size)

    def put(self, c: int, on: bool) -> None:
        i = self.size + c
        self.on[i] = on
        while i > 1:
            i //= 2
            up = self.on[2 * i] or self.on[2 * i + 1]
            if self.on[i] == up:
                break
            self.on[i] = up

    def find(self, x: int) -> int | None:
        i = self.size + x
        if self.on[i]:
            return x
        while i > 1:                                        # climb until a right neighbour has something
            if i % 2 == 0 and self.on[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.on[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], cap: int) -> np.ndarray:
    """Placements, one row per run: length, first rank, first bin, bins,
    pieces per bin, offset in the bin."""
    tree, open_bins, rows, bins = Tightest(cap), {}, [], 0

    def add(c: int, first: int, n: int) -> None:
        if c > 0 and n > 0:
            open_bins.setdefault(c, []).append((first, n))
            tree.put(c, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            c = tree.find(length)
            if c is None:
                c, each = cap, cap // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = open_bins[c].pop()
                if not open_bins[c]:
                    tree.put(c, False)
                each = c // length
            full, rest = min(n, left // each), 0
            if full:
                rows.append((length, rank, first, full, each, cap - c))
                add(c - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                rest = left
                rows.append((length, rank, first + full, 1, rest, cap - c))
                add(c - rest * length, first + full, 1)
                rank, left = rank + rest, 0
            used = full + (1 if rest else 0)
            if c < cap or used < n:
                add(c, first + used, n - used)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


PIECES = "no_id boolean, doc_id long, piece int, start long, length long, ids binary"


def cut(path: str, capacity: int, end_id: int):
    def run(batches):
        try:
            yield from pieces(batches)
        finally:
            T.encoder(path).forget()                         # the worker's next task may be another stage's

    def pieces(batches):
        for batch in batches:
            for b in T.slices(batch, 2, SLICE):
                ids, off = T.encode_with_end(path, b.column(2), end_id)
                n = np.diff(off)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     C.binary_array(ids.astype("<u4").tobytes(), edges)],
                    ["no_id", "doc_id", "piece", "start", "length", "ids"])
    return run


def cut_pieces(docs: DataFrame, id_col="doc_id", text_col="text", capacity=CAPACITY, end_id=END_ID,
               path: str | None = None) -> DataFrame:
    """Token pieces of every text: PIECES, ids as little-endian uint32."""
    rows = docs.select(F.col(id_col).isNull().alias("no_id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(C.lean(cut(path or T.vocabulary(), capacity, end_id)), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns
    doc_id, piece, length; lengths from 1 to ``capacity``)."""
    spark = pieces.sparkSession
    spread = 4 * C.partitions(spark)
    p = pieces.withColumn("__bucket", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {spread}) as int)"))
    counts = C.materialize(p.groupBy("length", "__bucket").agg(F.count("*").alias("__n")), "lengths")
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}
    if any(not 1 <= x <= capacity for x in total):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    rows = best_fit_decreasing(total, capacity)
    before = counts.select("length", "__bucket", (F.sum("__n").over(
        Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    order = [F.col(c) for c in pieces.columns if c != "ids"]
    ranked = (p.withColumn("__row", F.row_number().over(
        Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", *order)))
        .join(before, ["length", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__row") - 1).drop("__bucket", "__row", "__before"))
    rest = [f for f in pieces.schema.fields]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", sequence_id long, `offset` long"
    names = [f.name for f in rest]
    return ranked.select(*names, "__rank").mapInArrow(C.lean(place(rows, names)), out)


def place(rows: np.ndarray, names: list[str]):
    """Rank among equal lengths -> bin and offset, from the placements."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    lengths, group = np.unique(rows[:, 0], return_inverse=True) if len(rows) else (rows[:, 0], rows[:, 0])
    first = np.searchsorted(group, np.arange(len(lengths)))

    def run(batches):
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(len(names)).to_numpy()
            at = np.empty(len(length), np.int64)
            g = np.searchsorted(lengths, length)
            for x in np.unique(g):
                sel = g == x
                lo = first[x]
                hi = first[x + 1] if x + 1 < len(first) else len(rows)
                at[sel] = lo + np.searchsorted(rows[lo:hi, 1], rank[sel], side="right") - 1
            r = rows[at]
            q = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(r[:, 2] + q // r[:, 4]), pa.array(r[:, 5] + q % r[:, 4] * r[:, 0])],
                [*names, "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Packed pieces with their digest: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. The ids themselves are not shuffled."""
    with C.small_batches(docs.sparkSession, BATCH_ROWS):     # whole texts: a batch is held by the JVM and the worker
        pieces = C.materialize(cut_pieces(docs, id_col, text_col).withColumn("ids_crc32", F.crc32("ids")).drop("ids"),
                               "pieces")
    return pack(pieces).select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length",
                               "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.read(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
