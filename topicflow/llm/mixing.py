"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is cut into blocks of about ``block_words`` words. Source targets
are turned into whole numbers of blocks by highest quotients (divisors 1, 3,
5, ...), every source's seats are apportioned in the same way to its shards,
and each shard takes whole passes over its blocks plus a seeded choice of the
rest. A shard holds about ``shard_words`` words of one source (documents are
dealt by a hash of their id and text, so rows of one id or of none spread too), so a source that holds a third of all rows is
many shards, and no task sees more than one shard at a time.

Edge cases: null text and text without words have size 0 and are taken 0
times; a null source is a source of its own, sorted last; rows that repeat an
id are rows of their own; an empty table gives an empty result; a corpus
without any word has target 0 everywhere; other columns are not read by
``mix`` and are passed through by ``mixed_documents``.
"""
from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SEED = 17


def word_count(text):
    """Column: number of maximal runs of characters other than ASCII space."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(C.WORD)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT) -> list[float]:
    """Words wanted of each source, in source order: ``share`` times all words
    by cyclic weight, each stopping at ``most`` times the source's size; the
    excess is shared again by weight among the sources not yet full."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    full: set[int] = set()
    left = share * sum(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        total = sum(w[i] for i in rest)
        room = left - sum(most * sizes[i] for i in sorted(full))
        want = {i: room * w[i] / total for i in rest} if rest else {}
        over = [i for i in rest if want[i] > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in full else want[i] for i in range(len(sizes))]
        full.update(over)


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes/(2k+1), at most ``most[i]`` each; ties
    go to the earlier party. Starts from the rounded shares, which differ from
    the result by few seats, so the heap handles only the difference."""
    n, total = len(votes), float(sum(votes))
    cap = most or [seats] * n
    seats = min(seats, sum(c for c, v in zip(cap, votes) if v > 0))
    if total <= 0 or seats <= 0:
        return [0] * n
    got = [min(c, max(0, int(np.floor(seats * v / total)))) if v > 0 else 0 for v, c in zip(votes, cap)]
    # a seat beyond the final divisor is given back, one below it is added
    lack = seats - sum(got)
    add = [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < cap[i] and votes[i] > 0]
    heapq.heapify(add)
    for _ in range(max(0, lack)):
        _, i = heapq.heappop(add)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(add, (-votes[i] / (2 * got[i] + 1), i))
    while True:                                              # exchange until no quotient is out of order
        up = max(((votes[i] / (2 * got[i] + 1), -i) for i in range(n) if got[i] < cap[i] and votes[i] > 0),
                 default=None)
        down = min(((votes[i] / (2 * got[i] - 1), -i) for i in range(n) if got[i] > 0), default=None)
        if up is None or down is None or up <= down:
            return got
        got[-up[1]] += 1
        got[-down[1]] -= 1


def shard_plan(shards: list[tuple[str | None, int, int]], block_words: int, weights=WEIGHTS, share=SHARE,
               most=MAX_REPEAT):
    """From (source, shard, words): per source (size, target) and per shard
    (number of blocks, quota). Driver work over one number per shard."""
    order = sorted({s for s, _, _ in shards}, key=lambda s: (s is None, s or ""))
    size = {s: 0 for s in order}
    for s, _, n in shards:
        size[s] += n
    goal = dict(zip(order, targets([size[s] for s in order], weights, share, most)))
    blocks = {(s, k): -(-n // block_words) for s, k, n in shards}
    held = {s: 0 for s in order}
    for (s, _), b in blocks.items():
        held[s] += b
    # a source's blocks hold size/held words each; seats in such blocks, by the goal
    seats = dict(zip(order, sainte_lague([goal[s] * held[s] / size[s] if size[s] else 0.0 for s in order],
                                         round(sum(goal[s] * held[s] / size[s] for s in order if size[s])),
                                         [int(most * held[s]) for s in order])))
    quota = {}
    for s in order:
        own = sorted(k for x, k, _ in shards if x == s)
        words = {k: n for x, k, n in shards if x == s}
        for k, q in zip(own, sainte_lague([float(words[k]) for k in own], seats[s],
                                          [int(most * blocks[s, k]) for k in own])):
            quota[s, k] = q
    return size, goal, blocks, quota


def chosen_words(sizes: np.ndarray, blocks: int, quota: int, key: int, seed: int):
    """(whole passes, selected-word prefix function over the shard's words).

    Block j covers words [j*W//blocks, (j+1)*W//blocks)."""
    total = int(sizes.sum())
    passes, rest = divmod(quota, blocks) if blocks else (0, 0)
    edges = (np.arange(blocks + 1, dtype=np.float64) * total / max(blocks, 1)).astype(np.int64)
    pick = np.zeros(blocks, dtype=np.int64)
    if rest:
        pick[np.random.default_rng([seed, key & 0xFFFFFFFF, (key >> 32) & 0xFFFFFFFF]).permutation(blocks)[:rest]] = 1
    return passes, edges, pick


def prefix_words(x: np.ndarray, edges: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Selected words before position x."""
    if not len(pick):
        return np.zeros(len(x), dtype=np.int64)
    gain = np.concatenate([[0], np.cumsum(np.diff(edges) * pick)])
    j = np.clip(np.searchsorted(edges, x, side="right") - 1, 0, len(pick) - 1)
    return gain[j] + (x - edges[j]) * pick[j]


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", *more) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                       F.col(id_col).isNull().alias("no_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row_key"), *more)


def plan(rows: DataFrame, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, weights=WEIGHTS, share=SHARE,
         most=MAX_REPEAT):
    """Shards per source and quotas per shard, from a written table of
    (doc_id, source, size). The driver sees one number per source and per
    shard (one shard per ``shard_words`` words), never a document."""
    spark = rows.sparkSession
    per = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    cuts = spark.createDataFrame([(s, max(1, -(-int(n or 0) // shard_words))) for s, n in per.items()],
                                 "q_source string, cuts long")
    shards = [(r[0], r[1], int(r[2])) for r in
              deal(rows, cuts).groupBy("source", "shard").agg(F.sum("size")).collect()]
    size, goal, blocks, quota = shard_plan(shards, block_words, weights, share, most)
    frame = [(s, k, size[s], float(goal[s]), blocks[s, k], quota[s, k], n) for n, (s, k) in
             enumerate(sorted(blocks, key=lambda x: (x[0] is None, x[0] or "", x[1])))]
    return cuts, spark.createDataFrame(
        frame, "q_source string, q_shard long, source_size long, target double, blocks long, quota long, shard_no long")


def deal(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds the shard of each row."""
    return (rows.join(cuts, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
            .withColumn("shard", F.expr("pmod(row_key, cuts)")).drop("cuts"))


def runs_of(pdf: pd.DataFrame, seed: int):
    """Per shard: seeded document order, block choice, words of each document.
    Returns the ordered frame, the whole passes, and per document the runs
    (start, end in words of the document) taken beyond them."""
    pdf = pdf.sort_values(["order", "no_id", "doc_id", "size"], kind="stable").reset_index(drop=True)
    n = pdf["size"].to_numpy(np.int64)
    passes, edges, pick = chosen_words(n, int(pdf["blocks"].iat[0]), int(pdf["quota"].iat[0]),
                                       int(pdf["shard_no"].iat[0]), seed)
    end = np.cumsum(n)
    start = end - n
    on = np.flatnonzero(np.diff(np.concatenate([[0], pick, [0]])))           # selected runs of the shard
    lo, hi = edges[on[0::2]], edges[on[1::2]]
    first, last = np.searchsorted(hi, start, side="right"), np.searchsorted(lo, end, side="left")
    runs = [[(int(max(lo[j], s) - s), int(min(hi[j], e) - s)) for j in range(a, b)] if e > s else []
            for a, b, s, e in zip(first, last, start, end)]
    return pdf, passes, runs


TAKEN = "doc_id long, no_id boolean, size long, source_size long, target double, taken long"


def take(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, passes, runs = runs_of(pdf, seed)
        pdf["taken"] = passes * pdf["size"] + np.array([sum(b - a for a, b in r) for r in runs], dtype=np.int64)
        return pdf[["doc_id", "no_id", "size", "source_size", "target", "taken"]]
    return run


def placed(rows: DataFrame, cuts: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    on = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard"))
    return (deal(rows, cuts).join(quotas, on).drop("q_source", "q_shard", "shard")
            .withColumn("order", F.expr(f"xxhash64({seed}L, row_key)")))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED, **how) -> DataFrame:
    """What the mix takes: doc_id, size, source_size, target, taken."""
    rows = C.materialize(sized(docs, id_col, text_col, source_col), "sized")
    return (placed(rows, *plan(rows, **how), seed).groupBy("shard_no").applyInPandas(C.lean_group(take(seed)), TAKEN)
            .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "size", "source_size", "target",
                    "taken"))


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED,
                    **how) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document appears once
    per whole pass, and once per run of words taken beyond them, with the
    run's text as written (from its first to its last word). ``n_chars``,
    where present, is set to the length of a text that was cut. Documents that
    nothing is taken of do not appear."""
    names = docs.columns
    cuts, quotas = plan(C.materialize(sized(docs, id_col, text_col, source_col), "sized"), **how)
    rows = sized(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
    return (placed(rows, cuts, quotas, seed).groupBy("shard_no").applyInPandas(C.lean_group(cut_texts(seed, text_col)), out)
            .select(*[F.col(f"row.`{c}`").alias(c) for c in names]))


def cut_texts(seed: int, text_col: str):
    word = re.compile("[^\\x20\\x09-\\x0D]+")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, passes, runs = runs_of(pdf, seed)
        out = []
        for row, n, r in zip(pdf["row"], pdf["size"], runs):
            row = row if isinstance(row, dict) else row.asDict()
            if not n:
                continue
            out.extend([row] * passes)
            if r == [(0, n)]:
                out.append(row)
            elif r:
                text = row[text_col]
                at = [m.span() for m in word.finditer(text)]
                for a, b in r:
                    part = text[at[a][0]:at[b - 1][1]]
                    out.append({**row, text_col: part, **({"n_chars": len(part)} if "n_chars" in row else {})})
        return pd.DataFrame({"row": pd.Series(out, dtype=object)})
    return run


def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.read(spark, sf_dir, "documents"))


QUERIES = {"op6_sainte_lague_mix": op6_sainte_lague_mix}
ORACLES: dict[str, str] = {}
