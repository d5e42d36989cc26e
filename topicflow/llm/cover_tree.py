"""Embedding near-duplicates by dual traversal of cover trees, exact.

Equal vectors are one class. A farthest-first net over a bounded sample gives
the top level (cells); every class goes to its nearest cell, a cell with many
classes is dealt into blocks, and the exact covering radius of every cell is
aggregated over all rows. Pairs of blocks whose balls are too far apart are
never formed; a remaining pair is one task group, where each side gets a cover
tree (nested levels, radii halving) and the trees are traversed together,
dropping node pairs by their covering radii. Leaf pairs are compared in double
precision. A pair of blocks returns each class's number of links and a
spanning forest of them, so a dense group of near copies yields as many rows as
it has members, not pairs. The sample steers only which cell a vector goes to;
the links don't depend on it.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (n_links 0, a component of their own); vectors of
different lengths don't link; equal vectors link with each other; rows that
repeat a vec_id are vectors of their own; a null vec_id is never a component's
id unless all its members' ids are null; an empty table gives an empty result;
other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COSINE = 0.9
BLOCK = 4096              # classes of one cell compared as one block
MAX_CELLS = 64            # top-level nodes
SAMPLE = 4096             # rows the top level is chosen from
LEAF = 256                # points below which a node is not divided
SLACK = 1e-9              # rounding allowance of the bounds; never decides a link


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """First k centres of the farthest-first order of unit vectors."""
    if not len(x):
        return x
    centres, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(centres) < min(k, len(x)) and near.max() > 0:
        centres.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[centres[-1]], axis=1))
    return x[centres]


class Node:
    __slots__ = ("rows", "centre", "radius", "kids")

    def __init__(self, rows, centre, radius):
        self.rows, self.centre, self.radius, self.kids = rows, centre, radius, []


def cover_tree(x: np.ndarray) -> Node:
    """Nested levels with halving radii. A node whose points don't gather
    around few centres at half its radius stays a leaf."""
    root = Node(np.arange(len(x)), x[0], float(np.linalg.norm(x - x[0], axis=1).max(initial=0.0)))
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node.rows) <= LEAF or node.radius <= SLACK:
            continue
        half, left, kids = node.radius / 2, node.rows, []
        most = max(16, int(len(node.rows) ** 0.5))
        while len(left) and len(kids) < most:
            c = x[left[0]]
            d = np.linalg.norm(x[left] - c, axis=1)
            kids.append(Node(left[d <= half], c, float(d[d <= half].max())))
            left = left[d > half]
        if len(left) > len(node.rows) // 2:                  # too spread out for this level
            continue
        if len(left):
            d = np.linalg.norm(x[left] - x[left[0]], axis=1)
            kids.append(Node(left, x[left[0]], float(d.max())))
        node.kids = kids
        stack.extend(kids)
    return root


class Forest:
    """Union-find over 0..n-1, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, v: np.ndarray) -> np.ndarray:
        r = self.up[v]
        while (s := self.up[r]).tolist() != r.tolist():
            r = s
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def edges(self):
        v = np.arange(len(self.up))
        r = self.roots(v)
        return v[r != v], r[r != v]


def links(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, same: bool, cosine: float):
    """Links between unit vectors x and y (or within x, if ``same``): links
    per row of each side, weighted by the other's class size, and a forest."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    tx = cover_tree(x)
    ty = tx if same else cover_tree(y)
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = Forest(len(x) if same else len(x) + len(y))
    shift = 0 if same else len(x)
    stack = [(tx, ty)]
    while stack:
        a, b = stack.pop()
        if a is not b and np.linalg.norm(a.centre - b.centre) - a.radius - b.radius > reach:
            continue
        if a.kids or b.kids:
            if same and a is b:
                stack.extend((p, q) for i, p in enumerate(a.kids) for q in a.kids[i:])
            elif a.kids and (not b.kids or a.radius >= b.radius):
                stack.extend((k, b) for k in a.kids)
            else:
                stack.extend((a, k) for k in b.kids)
            continue
        for i in range(0, len(a.rows), 512):
            rows = a.rows[i:i + 512]
            c = x[rows] @ y[b.rows].T
            hit = c >= cosine - SLACK
            p, q = np.nonzero(hit)
            if not len(p):
                continue
            close = np.flatnonzero(np.abs(c[p, q] - cosine) <= SLACK)
            if len(close):                                   # as close to the limit as rounding: sum with care
                exact = np.einsum("ij,ij->i", x[rows[p[close]]].astype(np.longdouble), y[b.rows[q[close]]])
                drop = close[exact.astype(np.float64) < cosine]
                p, q = np.delete(p, drop), np.delete(q, drop)
            p, q = rows[p], b.rows[q]
            if same and a is b:
                p, q = p[p < q], q[p < q]
            np.add.at(cx, p, ny[q])
            np.add.at(cx if same else cy, q, nx[p])
            forest.link(p, q + shift)
    return cx, cy, forest.edges()


def unit(raw) -> np.ndarray:
    x = np.vstack(raw).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)             # keeps squares of huge and tiny values finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


OUT = "kind int, a long, b long"          # kind 0: class a has b more links; kind 1: classes a and b are linked


def compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0])
        side = pdf["block"].to_numpy() == lo
        p = pdf[side]
        q = p if lo == hi else pdf[~side]
        if not len(p) or not len(q):
            return pd.DataFrame({"kind": [], "a": [], "b": []})
        x, y = unit(p["v"]), unit(q["v"])
        cx, cy, (u, r) = links(x, p["n"].to_numpy(), y, q["n"].to_numpy(), lo == hi, cosine)
        ids = p["cid"].to_numpy() if lo == hi else np.concatenate([p["cid"].to_numpy(), q["cid"].to_numpy()])
        n = np.concatenate([cx, cy]) if lo != hi else cx
        on = np.flatnonzero(n)
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(on), len(u)]),
                             "a": np.concatenate([ids[on], ids[u]]), "b": np.concatenate([n[on], ids[r]])})
    return run


def nearest(centres: np.ndarray):
    """Arrow tasks: nearest cell of every class, and the distance to it."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column(2).to_pandas())
            d2 = 2 - 2 * (x @ centres.T)
            cell = d2.argmin(axis=1)
            far = np.linalg.norm(x - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far)],
                                             ["cid", "n", "v", "cell", "far"])
    return run


def block_plan(centres: np.ndarray, radius: np.ndarray, count: np.ndarray, cosine: float, block: int):
    """First block and number of blocks per cell, and for each cell the cells
    that are near enough to hold a partner."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    blocks = np.maximum(1, -(-count // block))
    first = np.cumsum(blocks) - blocks
    near = np.linalg.norm(centres[:, None] - centres[None], axis=2) - radius[:, None] - radius[None] <= reach
    np.fill_diagonal(near, True)
    return first, blocks, near


def class_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK, cells: int = MAX_CELLS) -> DataFrame:
    """OUT rows for a written table of classes (cid, n, v) of one length."""
    spark = classes.sparkSession
    total = classes.count()
    if not total:
        return spark.createDataFrame([], OUT)
    sample = [r[0] for r in classes.orderBy(F.xxhash64("cid")).limit(SAMPLE).select("v").collect()]
    centres = farthest_first(unit(sample), max(1, min(cells, -(-total // block))))
    placed = C.materialize(classes.select("cid", "n", "v").mapInArrow(nearest(centres), "cid long, n long, v array<float>, cell int, far double"), "cells")
    stats = {r[0]: (r[1], r[2]) for r in placed.groupBy("cell").agg(F.max("far"), F.count("*")).collect()}
    radius = np.array([stats.get(i, (0.0, 0))[0] for i in range(len(centres))]) + SLACK
    count = np.array([stats.get(i, (0.0, 0))[1] for i in range(len(centres))], dtype=np.int64)
    first, blocks, near = block_plan(centres, radius, count, cosine, block)
    cell = spark.createDataFrame(
        [(i, int(first[i]), int(blocks[i]),
          [[int(first[j]), int(first[j] + blocks[j] - 1)] for j in range(len(centres)) if near[i, j] and count[j]])
         for i in range(len(centres))], "cell int, first int, blocks int, near array<array<int>>")
    pairs = (placed.join(F.broadcast(cell), "cell")          # at most MAX_CELLS rows
             .withColumn("block", F.expr("first + cast(pmod(xxhash64(cid), blocks) as int)"))
             .withColumn("other", F.explode(F.expr("flatten(transform(near, r -> sequence(r[0], r[1])))")))
             .select("cid", "n", "v", "block", F.least("block", "other").alias("lo"),
                     F.greatest("block", "other").alias("hi")))
    return pairs.groupBy("lo", "hi").applyInPandas(compare(cosine), OUT)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    good = F.expr("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < float('inf')) "
                  "and exists(v, c -> c <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = C.materialize(rows.where("good").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
                            .withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = [r[0] for r in classes.select(F.size("v")).distinct().collect()]             # vector lengths in use
    found = None
    for size in sizes:
        one = class_links(classes.where(F.size("v") == size), cosine, block)
        found = one if found is None else found.unionByName(one)
    spark = vectors.sparkSession
    found = C.materialize(found if found is not None else spark.createDataFrame([], OUT), "links")
    more = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("more"))
    comp = C.connected_components(found.where("kind = 1").select("a", "b"))
    linked = classes.select("cid", "rep").join(comp.withColumnRenamed("id", "cid"), "cid")
    # written, so that both sides of the next join are exchanges that may be split at a large component
    least = C.materialize(linked.groupBy("component_id").agg(F.min("rep").alias("low")), "least")
    low = linked.join(least, "component_id").select("cid", "low")
    known = C.materialize(classes.join(more, "cid", "left").join(low, "cid", "left")
                          .select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                                  F.coalesce("low", "rep").alias("component_id")), "known")
    a = rows.where("good").join(known, "v").select("vec_id", "n_links", "component_id")
    b = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return a.unionByName(b).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, cast(v AS DOUBLE[]) AS v FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.id),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

QUERIES = {"op9_cover_tree": op9_cover_tree}
ORACLES = {"op9_cover_tree": SQL}
