"""Exact seeded sampling and splitting.

W00 ``exact_rank`` gives every row a rank 1..n inside its group from the key
``md5(seed ':' id)`` with ties by id. A plain ``row_number()`` over the group
would put a whole group (a third of the corpus for one domain) into one task.
Instead:

1. count rows per ``(group, bucket)`` where bucket = first 4 hex digits of
   the key (65,536 buckets per group; partial aggregation, narrow columns);
2. prefix-sum that small table per group (bounded: groups x 16^digits rows),
   broadcast it back after a size check;
3. rank inside each ``(group, bucket)``; global rank = offset + local rank.

Rows whose bucket starts after a requested cut are dropped before the
shuffle, so a sample only moves the rows it can keep. Samples and splits that
don't report ranks use ``cut_keys``: only keys of one bucket per cut are
ordered, and no row is shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small

KEY, BUCKET, OFFSET, BUCKET_N = "_tf_key", "_tf_bucket", "_tf_offset", "_tf_bucket_n"


def rank_key(id_col: str | Column, seed: int = 42) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def bucket_offsets(df: DataFrame, by: Sequence[str], id_col: str = "doc_id",
                   seed: int = 42, digits: int = 4) -> DataFrame:
    """Per ``(group, bucket)``: rows before the bucket (``_tf_offset``) and in
    it (``_tf_bucket_n``). Size-checked for broadcast."""
    k = rank_key(id_col, seed)
    counts = (df.select(*by, F.substring(k, 1, digits).alias(BUCKET))
              .groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias(BUCKET_N)))
    w = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn(OFFSET, F.coalesce(F.sum(BUCKET_N).over(w), F.lit(0)).cast("bigint"))
    return broadcast_if_small(offs)


def exact_rank(df: DataFrame, by: Sequence[str] = (), id_col: str = "doc_id",
               seed: int = 42, out: str = "rank", upto: Column | None = None,
               offsets: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Add ``out`` = exact 1-based rank inside ``by`` groups.

    ``upto`` (a Column over the group columns and ``_tf_offset``) may bound
    the ranks needed; rows in buckets starting beyond it skip the shuffle.
    """
    by = list(by)
    offs = offsets if offsets is not None else bucket_offsets(df, by, id_col, seed, digits)
    keyed = df.withColumn(KEY, rank_key(id_col, seed)).withColumn(BUCKET, F.substring(KEY, 1, digits))
    j = keyed.join(offs.select(*by, BUCKET, OFFSET), [*by, BUCKET], "inner")
    if upto is not None:
        j = j.filter(F.col(OFFSET) < upto)
    w = Window.partitionBy(*by, BUCKET).orderBy(KEY, id_col)
    return (j.withColumn(out, (F.col(OFFSET) + F.row_number().over(w)).cast("bigint"))
            .drop(KEY, BUCKET, OFFSET))


def group_sizes(offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    return offsets.groupBy(*by).agg(F.sum(BUCKET_N).cast("bigint").alias("n"))


def cut_keys(df: DataFrame, by: Sequence[str], cuts: DataFrame, id_col: str = "doc_id", seed: int = 42,
             offsets: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """The (key, id) at given ranks: ``cuts`` holds (by..., name, at) and the
    result (by..., name, cut). A cut of the ranking needs no ranks: only the
    bucket in which it falls is ordered, on keys alone, and every other row
    is told by comparing its key with the cut. ``at`` = 0 has no row."""
    by = list(by)
    offs = offsets if offsets is not None else bucket_offsets(df, by, id_col, seed, digits)
    edge = (offs.join(cuts, by) if by else offs.join(cuts, F.lit(True)))     # both sides: one row per group and bucket
    edge = edge.where((F.col(OFFSET) < F.col("at")) & (F.col("at") <= F.col(OFFSET) + F.col(BUCKET_N)))
    edge = broadcast_if_small(edge.select(*by, BUCKET, OFFSET, "name", "at"))
    keyed = (df.select(*by, id_col).withColumn(KEY, rank_key(id_col, seed))
             .withColumn(BUCKET, F.substring(KEY, 1, digits)))
    w = Window.partitionBy(*by, BUCKET, "name").orderBy(KEY, id_col)
    hit = (keyed.join(edge, [*by, BUCKET]).withColumn("_tf_row", F.row_number().over(w))
           .where(F.col(OFFSET) + F.col("_tf_row") == F.col("at")))
    return hit.select(*by, "name", F.struct(F.col(KEY).alias("key"), F.col(id_col).alias("id")).alias("cut"))


def within_cuts(df: DataFrame, by: Sequence[str], cuts: DataFrame, names: Sequence[str], id_col: str = "doc_id",
                seed: int = 42) -> DataFrame:
    """Adds one boolean column per cut name: is the row's rank within it?
    Rows keep their place: the cuts (one row per group) are joined by a
    size-checked broadcast, and nothing else moves."""
    by = list(by)
    wide = cuts.groupBy(*by).agg(*[F.first(F.when(F.col("name") == n, F.col("cut")), ignorenulls=True).alias(f"_tf_{n}")
                                   for n in names])
    wide = broadcast_if_small(wide, 1_000_000)
    j = df.join(wide, by, "left") if by else df.join(wide, F.lit(True), "left")
    mine = F.struct(rank_key(id_col, seed).alias("key"), F.col(id_col).alias("id"))
    for n in names:
        j = j.withColumn(n, F.coalesce(mine <= F.col(f"_tf_{n}"), F.lit(False))).drop(f"_tf_{n}")
    return j


def balanced_sample(df: DataFrame, by: str = "domain", id_col: str = "doc_id",
                    seed: int = 42) -> DataFrame:
    """W01 with ranks: every group sampled down to the smallest group size
    (G01), without replacement, fixed seed. Adds ``rank``; meant for narrow
    rows, see :func:`balanced_rows`."""
    offs = bucket_offsets(df, [by], id_col, seed)
    n = group_sizes(offs, [by]).agg(F.min("n")).first()[0] or 0
    ranked = exact_rank(df, [by], id_col, seed, upto=F.lit(n), offsets=offs)
    return ranked.filter(F.col("rank") <= n)


def balanced_rows(df: DataFrame, by: str = "domain", id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """W01 without ranks: the same rows, chosen by cut key where they are."""
    offs = bucket_offsets(df, [by], id_col, seed)
    sizes = group_sizes(offs, [by])
    n = sizes.agg(F.min("n")).first()[0] or 0
    cuts = cut_keys(df, [by], sizes.select(by, F.lit("_tf_in").alias("name"), F.lit(n).cast("long").alias("at")), id_col, seed, offs)
    return within_cuts(df, [by], cuts, ["_tf_in"], id_col, seed).where("_tf_in").drop("_tf_in")


def fraction_sample(df: DataFrame, fraction: float, id_col: str = "doc_id",
                    seed: int = 42) -> DataFrame:
    """Global sample of ``round_half_even(fraction * n)`` rows."""
    offs = bucket_offsets(df, [], id_col, seed)
    total = offs.agg(F.sum(BUCKET_N)).first()[0] or 0
    k = int(round(fraction * total))          # Python round = half to even
    ranked = exact_rank(df, [], id_col, seed, upto=F.lit(k), offsets=offs)
    return ranked.filter(F.col("rank") <= k)


def split_sizes(n: Column) -> tuple[Column, Column, Column]:
    """W03 stratum sizes, integer arithmetic only:
    hold = ceil(0.3 n) = (3n+9) div 10, test = ceil(hold/2), val = hold - test."""
    hold = F.floor((n * 3 + 9) / 10).cast("bigint")
    test = F.floor((hold + 1) / 2).cast("bigint")
    return (n - hold).cast("bigint"), (hold - test).cast("bigint"), test


def stratified_split(df: DataFrame, by: str | Sequence[str] = "domain", id_col: str = "doc_id",
                     seed: int = 42, with_rank: bool = False) -> DataFrame:
    """70/15/15 train/val/test per stratum. Adds ``split``. Without ranks
    the rows (and their texts) stay where they are and are labelled by two cut
    keys per stratum; ``with_rank`` adds ``rank`` and shuffles the rows."""
    by = [by] if isinstance(by, str) else list(by)
    offs = bucket_offsets(df, by, id_col, seed)
    sizes = group_sizes(offs, by)
    n_train, n_val, _ = split_sizes(F.col("n"))
    if with_rank:
        sizes = broadcast_if_small(sizes.select(*by, n_train.alias("_n_train"), n_val.alias("_n_val")), 1_000_000)
        j = exact_rank(df, by, id_col, seed, offsets=offs).join(sizes, by)
        split = (F.when(F.col("rank") <= F.col("_n_train"), "train")
                 .when(F.col("rank") <= F.col("_n_train") + F.col("_n_val"), "val").otherwise("test"))
        return j.withColumn("split", split).drop("_n_train", "_n_val")
    at = sizes.select(*by, F.explode(F.create_map(F.lit("_tf_train"), n_train, F.lit("_tf_val"), n_train + n_val))
                      .alias("name", "at"))
    j = within_cuts(df, by, cut_keys(df, by, at, id_col, seed, offs), ["_tf_train", "_tf_val"], id_col, seed)
    split = F.when(F.col("_tf_train"), "train").when(F.col("_tf_val"), "val").otherwise("test")
    return j.withColumn("split", split).drop("_tf_train", "_tf_val")


SIZE_PERCENTS = (25, 50, 75, 100)


def nested_size_samples(df: DataFrame, percents: Sequence[int] = SIZE_PERCENTS,
                        id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """One row per (row, percent) for every percent whose prefix holds
    the row; prefixes of one ranking, so samples are nested."""
    offs = bucket_offsets(df, [], id_col, seed)
    total = offs.agg(F.sum(BUCKET_N)).first()[0] or 0
    cuts = {p: int(round(p * total / 100)) for p in percents}
    ranked = exact_rank(df, [], id_col, seed, offsets=offs, upto=F.lit(max(cuts.values(), default=0)))
    arr = F.array(*[F.when(F.col("rank") <= c, F.lit(p)) for p, c in sorted(cuts.items())])
    return (ranked.withColumn("pct", F.explode(F.filter(arr, lambda x: x.isNotNull())))
            .withColumn("pct", F.col("pct").cast("int")))


def size_shares(df: DataFrame, percents: Sequence[int] = SIZE_PERCENTS, id_col: str = "doc_id",
                seed: int = 42) -> DataFrame:
    """W04 without ranks: the rows of the nested samples, by cut keys."""
    offs = bucket_offsets(df, [], id_col, seed)
    total = offs.agg(F.sum(BUCKET_N)).first()[0] or 0
    cuts = df.sparkSession.createDataFrame([(f"_tf_{p}", int(round(p * total / 100))) for p in percents], "name string, at long")
    names = [f"_tf_{p}" for p in percents]
    j = within_cuts(df, [], cut_keys(df, [], cuts, id_col, seed, offs), names, id_col, seed)
    arr = F.array(*[F.when(F.col(f"_tf_{p}"), F.lit(p)) for p in sorted(percents)])
    return (j.withColumn("pct", F.explode(F.filter(arr, lambda x: x.isNotNull())))
            .withColumn("pct", F.col("pct").cast("int")).drop(*names))


def seeded_order(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Deterministic shuffle order key (sort only when writing)."""
    return df.withColumn("shuffle_key", rank_key(id_col, seed))


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """Example rows, ``orderBy(...).limit(n)`` (TakeOrdered, no full sort)."""
    return df.orderBy(*order).limit(n)
