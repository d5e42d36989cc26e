"""N-gram Jaccard join by parity sketches, exact.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Its
parity sketch is cut into parts: a hash falls into one part, and a part's value
is the XOR of its hashes (a second, small sketch of single bits serves as a
filter). One shingle in which two sets differ changes one part, so the number
of parts that differ (and of bits) is a lower bound of the symmetric
difference, and Jaccard >= 3/4 allows at most (|A| + |B|) / 7 differences. The
number of parts is fixed per size band such that a set has more parts with
something in them than it may have differences: by the pigeonhole principle a
pair shares the value of such a part. Sets near the lower end of a band also
give keys under the band below, where smaller partners are.

Only components are asked for, so links within a group of equal keys are not
enumerated: first every member is compared with the group's first; then only
members that are not yet connected, pair by pair, in groups of at most SMALL
members. Keys of more members (a passage that very many documents share) can be
left out for a set that keeps more other parts than it may have differences;
sets without that many are compared in blocks, by sketch, with those of the
same large key that are not yet connected. Candidates are compared by bit
sketch, then verified on the full sets. Sets with fewer filled parts than
needed (hash accidents) get keys of single shingles instead. Equal sets are one
class from the start, identified by 64-bit hashes.

Edge cases: null or word-less texts have an empty set (0 shingles), link with
nothing and are their own component; texts of one to four words are one
shingle; repeated rows are members of one class; a null doc_id is a
component's id only if all its members' ids are null; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

WORDS = 5
SMALL = 32                 # members of a key that are compared pair by pair
FINE = 64                  # sets below this size have one part per shingle
BLOCK = 2048               # members of a large key compared as one block
HEAD = 256                 # first large keys by which a pair's first common one is told
FLUSH = 500_000            # keys a task holds before it passes them on
SLICE = 2 << 20            # bytes of text handled at once
ROWS = 1000                # rows of an Arrow batch
KNOWN = 200_000            # classes a task remembers as sent
PACK = 10_000              # large keys of a row
PACKED = -2                # the scheme of such rows
SHIFT = 42                 # a key's low bits; the scheme's number stands above them
M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")))
    first = words.offsets[0].as_py()
    flat = words.values.slice(first, words.offsets[-1].as_py() - first)
    row = np.repeat(np.arange(len(text)), np.diff(words.offsets.to_numpy(zero_copy_only=False)))
    coded = flat.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(names):
        return [np.zeros(0, np.uint64) for _ in range(len(text))]
    some = (names != "")[code]                               # white space at a text's ends leaves empty words
    h = pd.util.hash_array(names, categorize=False).astype(np.uint64)[code[some]]
    count = np.bincount(row[some], minlength=len(text))
    off = np.concatenate([[0], np.cumsum(count)])
    n = len(h)
    if n >= k:
        s = h[:n - k + 1] * M[0]
        for i in range(1, k):
            s += h[i:n - k + 1 + i] * M[i]
        s = mix(s)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a:b - k + 1]))
        elif b > a:
            x = (h[a:b] * np.array(M[:b - a])).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64)
            out.append(mix(x ^ M[4]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(s: np.ndarray) -> int:
    """64 bits that identify a set: two independent sums, mixed."""
    total = (int(mix(s ^ M[1]).sum(dtype=np.uint64)) + len(s) * int(M[2])) & 0xFFFFFFFFFFFFFFFF
    both = np.array([total, int(np.bitwise_xor.reduce(mix(s ^ M[3])))], np.uint64)
    return int(mix(both[:1] ^ mix(both[1:])).view(np.int64)[0])


def bits(s: np.ndarray) -> bytes:
    """Parity sketch of single bits, two per element (a power of two)."""
    size = max(256, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches; the longer is folded by XOR."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def band(n: int) -> int:
    return 0 if n < FINE else (n // FINE).bit_length()


def parts_of(scheme: int) -> int:
    """Number of parts in a band [FINE * 2**(scheme-1), FINE * 2**scheme)."""
    top = FINE << scheme
    return top if scheme <= 2 else top // 2


def schemes(n: int) -> list[tuple[int, int]]:
    """(scheme, most differences from a partner there) for a set of n: its own
    band, where it may be the smaller partner, and the band below if that can
    hold a smaller partner."""
    own = band(n)
    out = [(own, n // 3)]
    if own and 3 * n < 4 * (FINE << (own - 1)):
        out.append((own - 1, 2 * n // 7))
    return out


def part_keys(s: np.ndarray, scheme: int) -> np.ndarray:
    """One 64-bit key per part with something in it."""
    tag = np.uint64((scheme + 1) * int(M[4]) & 0xFFFFFFFFFFFFFFFF)
    if scheme == 0:
        return mix(s ^ tag)
    k = np.uint64(parts_of(scheme))
    part = ((s >> np.uint64(32)) * k) >> np.uint64(32)       # in order, as s is sorted
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return mix(mix(np.bitwise_xor.reduceat(s, start)) + (part[start] + np.uint64(1)) * tag)


SETS = "no_id boolean, doc_id long, cid long, n long, sketch binary, slack array<struct<scheme:int,parts:long,most:long>>"


def describe(batches):
    """Per document: class, size, bit sketch, filled parts per scheme."""
    kind = pa.list_(pa.struct([("scheme", pa.int32()), ("parts", pa.int64()), ("most", pa.int64())]))
    for batch in batches:
        for b in T.slices(batch, 2, SLICE):
            cid, n, sk, slack = [], [], [], []
            for s in shingle_sets(b.column(2)):
                n.append(len(s))
                cid.append(class_id(s) if len(s) else None)
                sk.append(bits(s) if len(s) else None)
                slack.append([{"scheme": j, "parts": len(part_keys(s, j)), "most": d} for j, d in schemes(len(s))] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(sk, pa.binary()),
                 pa.array(slack, kind)], ["no_id", "doc_id", "cid", "n", "sketch", "slack"])


EXCHANGE = "pid int, cids binary, counts binary, keys binary"


def emit_keys(parts: int, fine: bool):
    """Keys of every class of a task, dealt to reduce partitions: the low bits
    of a key choose the partition, the high ones and the scheme are sent."""
    def out(cids, schemes_, keys):
        n = [len(k) for k in keys]
        key = np.concatenate(keys)
        cid = np.repeat(np.array(cids, np.int64), n)
        pid = ((key & np.uint64((1 << 64 - SHIFT) - 1)) % np.uint64(parts)).astype(np.int32)
        key = (np.repeat(np.array(schemes_, np.uint64), n) << np.uint64(SHIFT)) | (key >> np.uint64(64 - SHIFT))
        order = np.argsort(pid, kind="stable")
        pid, cid, key = pid[order], cid[order], key[order]
        at = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
        rows = []
        for a, b in zip(at, [*at[1:], len(pid)]):
            own = cid[a:b]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rows.append((int(pid[a]), own[new].tobytes(), np.diff(np.append(new, b - a)).astype(np.uint32).tobytes(),
                         key[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                          ["pid", "cids", "counts", "keys"])

    def run(batches):
        seen, cids, own, keys, n = set(), [], [], [], 0
        for batch in batches:
            for b in T.slices(batch, 0, SLICE):
                for s in shingle_sets(b.column(0)):
                    if not len(s) or (c := class_id(s)) in seen:
                        continue
                    seen.add(c)
                    for j in [0] if fine else [j for j, _ in schemes(len(s))]:
                        cids.append(c)
                        own.append(j)
                        keys.append(part_keys(s, j))
                        n += len(keys[-1])
                    if n >= FLUSH:
                        yield out(cids, own, keys)
                        cids, own, keys, n = [], [], [], 0
                if len(seen) > KNOWN:                        # a class sent twice is one member of its groups
                    seen.clear()
        if n:
            yield out(cids, own, keys)
    return run


GROUPS = "scheme int, key long, members array<long>"


def group_keys(small: int, parts: int):
    """What the keys of a reduce partition tell. Without ``key``: the members of
    a small group, once per set of members. Scheme -1: the classes that share a
    key with class ``key`` as its first, once per partition. Scheme PACKED: large
    keys of the classes of bucket ``key``, many in a row (see ``large_keys``)."""
    def run(batches):
        cids, keys = [], []
        for b in batches:
            for c, n, k in zip(b.column(1), b.column(2), b.column(3)):
                cids.append(np.repeat(np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.uint32)))
                raw = np.zeros((len(cids[-1]), 8), np.uint8)
                raw[:, :6] = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, 6)
                keys.append(raw.view(np.uint64)[:, 0])
        if not keys:
            return
        key, cid = np.concatenate(keys), np.concatenate(cids)
        del keys, cids
        order = np.argsort(key)
        key, cid = key[order], cid[order]
        same = key[1:] == key[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, cid = key[many], cid[many]
        order = np.lexsort((cid, key))
        key, cid = key[order], cid[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])])[:len(key)]     # one class, several tasks
        key, cid = key[new], cid[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[:len(key)]
        size = np.diff(np.append(start, len(key)))
        rest = np.ones(len(key), bool)
        rest[start] = False
        star = np.unique(np.stack([np.repeat(cid[start], size)[rest], cid[rest]], axis=1), axis=0)
        for i in range(0, len(star), 100_000):
            lead, at = np.unique(star[i:i + 100_000, 0], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lead), -1, np.int32)), pa.array(lead),
                 pa.ListArray.from_arrays(pa.array(np.append(at, len(star[i:i + 100_000])).astype(np.int32)),
                                          pa.array(star[i:i + 100_000, 1]))], ["scheme", "key", "members"])
        for g in np.unique(size[(size > 1) & (size <= small)]):
            at = start[size == g]
            rows = np.unique(cid[at[:, None] + np.arange(g)], axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(rows), np.int32)), pa.nulls(len(rows), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * int(g)), pa.array(rows.reshape(-1)))],
                ["scheme", "key", "members"])
        large = np.repeat(size, size) > small
        if large.any():
            k, c = key[large].astype(np.int64), cid[large]
            bucket = (mix(c.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((c, bucket))
            k, c, bucket = k[order], c[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for i, j in zip(edges, [*edges[1:], len(k)]):
                for x in range(i, j, PACK):
                    own, n = np.unique(c[x:min(j, x + PACK)], return_counts=True)
                    row = np.concatenate([[len(own)], own, n, k[x:min(j, x + PACK)]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([PACKED], pa.int32()), pa.array([bucket[i]]), pa.array([row], pa.list_(pa.int64()))],
                        ["scheme", "key", "members"])
    return run


def candidate_groups(docs: DataFrame, fine: bool = False, small: int = SMALL) -> DataFrame:
    parts = C.partitions(docs.sparkSession)
    return (docs.select("body").mapInArrow(C.lean(emit_keys(parts, fine)), EXCHANGE)
            .repartitionById(parts, F.col("pid")).mapInArrow(C.lean(group_keys(small, parts)), GROUPS))


def unpack(batches):
    """Scheme, class and large keys of a bucket's classes."""
    cids, keys = [], []
    for b in batches:
        for row in b.column(0):
            v = row.values.to_numpy()
            m = int(v[0])
            cids.append(np.repeat(v[1:1 + m], v[1 + m:1 + 2 * m]))
            keys.append(v[1 + 2 * m:])
    if not keys:
        return
    c, k = np.concatenate(cids), np.concatenate(keys)
    del cids, keys
    scheme = (k >> SHIFT).astype(np.int32)
    order = np.lexsort((k, c, scheme))
    k, c, scheme = k[order], c[order], scheme[order]
    at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (scheme[1:] != scheme[:-1])]))
    ends = np.append(at, len(k))
    for i in range(0, len(at), ROWS):
        part = ends[i:i + ROWS + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(scheme[part[:-1]]), pa.array(c[part[:-1]]),
             pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(k[part[0]:part[-1]]))],
            ["scheme", "cid", "keys"])


def large_keys(groups: DataFrame) -> DataFrame:
    """Large keys of each class and scheme, one row each."""
    parts = C.partitions(groups.sparkSession)
    return (groups.where(f"scheme = {PACKED}").select(F.col("key").cast("int").alias("bucket"), "members")
            .repartitionById(parts, F.col("bucket")).select("members").mapInArrow(C.lean(unpack), "scheme int, cid long, keys array<long>"))


def by_sketch(batches):
    """Pairs whose sizes and bit sketches allow a link."""
    for b in batches:
        n1, n2 = b.column(2).to_numpy(), b.column(4).to_numpy()
        ok = 4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)
        for i in np.flatnonzero(ok):
            ok[i] = 7 * hamming(b.column(3)[i].as_py(), b.column(5)[i].as_py()) <= n1[i] + n2[i]
        yield b.select(["a", "b"]).filter(pa.array(ok))


def full_sets(batches):
    """Class and full set of each document, a class once per task."""
    seen = set()
    for batch in batches:
        for b in T.slices(batch, 0, SLICE):
            cid, body = [], []
            for s in shingle_sets(b.column(0)):
                if len(s) and (c := class_id(s)) not in seen:
                    seen.add(c)
                    cid.append(c)
                    body.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(body, pa.binary())], ["cid", "body"])
            if len(seen) > KNOWN:
                seen.clear()


def verify(batches):
    for b in batches:
        ok = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) + len(y) < 64 else int(
                np.isin(x, y, assume_unique=True).sum())
            ok[i] = 100 * both >= 75 * (len(x) + len(y) - both)
        yield b.select(["a", "b"]).filter(pa.array(ok))


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b of class ids) that are links, written."""
    k = classes.select("cid", "n", "sketch")
    a = k.toDF("a", "n_a", "sketch_a")
    b = k.toDF("b", "n_b", "sketch_b")
    close = C.materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
                          .mapInArrow(C.lean(by_sketch), "a long, b long"), "close")
    used = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    reps = classes.join(used, "cid").select(F.col("rep_null").alias("no_id"), F.col("rep").alias("doc_id"))
    sets = C.materialize(docs.join(reps, ["no_id", "doc_id"], "left_semi").select("body")
                         .mapInArrow(C.lean(full_sets), "cid long, body binary").groupBy("cid").agg(F.first("body").alias("body")), "sets")
    full = (close.join(sets.toDF("a", "body_a"), "a").join(sets.toDF("b", "body_b"), "b")
            .select("a", "b", "body_a", "body_b").mapInArrow(C.lean(verify), "a long, b long"))
    return C.materialize(full, "linked")


def with_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """cid -> root, for classes with a link."""
    return C.materialize(C.connected_components(edges).select(F.col("id").alias("cid"), F.col("component_id").alias("root")), "roots")


def pairs_of(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of members of small groups that are not connected yet."""
    g = groups.withColumn("gid", F.monotonically_increasing_id())
    m = (g.select("gid", F.explode("members").alias("cid")).join(roots, "cid", "left")
         .select("gid", "cid", F.coalesce("root", "cid").alias("root")))
    open_ = m.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                 F.sort_array(F.collect_list(F.struct("cid", "root"))).alias("m")).where("lo <> hi")
    return open_.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(filter(m, y -> y.cid > x.cid and y.root <> x.root), "
        "y -> struct(x.cid as a, y.cid as b))))")).alias("p")).select("p.*").distinct()


def sketch_matrix(sketches) -> np.ndarray:
    """Bit sketches as rows of words, folded to the shortest among them."""
    rows = [np.frombuffer(x, np.uint64) for x in sketches]
    width = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in rows])


def met_before(p_heads, q_heads, limit: int) -> np.ndarray:
    """Marks the pairs (row of p, row of q) that share a key below ``limit``,
    so that a pair is given by its first common key only."""
    done = np.zeros((len(p_heads), len(q_heads)), bool)
    sides = []
    for heads in (p_heads, q_heads):
        heads = [np.asarray(h, np.int64) for h in heads]
        value, row = np.concatenate(heads), np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        low = value < limit
        order = np.argsort(value[low], kind="stable")
        sides.append((value[low][order], row[low][order]))
    for v in np.intersect1d(sides[0][0], sides[1][0]):
        rows = [row[np.searchsorted(value, v):np.searchsorted(value, v, side="right")] for value, row in sides]
        done[np.ix_(*rows)] = True
    return done


def block_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one large key between two blocks, allowed by size and sketch."""
    lo, hi = int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0])
    cid, n, root, head = (pdf[c].to_numpy() for c in ("cid", "n", "root", "head"))
    bits_ = sketch_matrix(pdf["sketch"])
    p, q = np.flatnonzero(pdf["block"] == lo), np.flatnonzero(pdf["block"] == hi)
    done = met_before(head[p], head[q], int(pdf["rank"].iat[0]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, i in enumerate(p):
        j = q[~done[at]]
        j = j if lo != hi else j[j > i]
        j = j[(root[j] != root[i]) & (4 * n[j] >= 3 * n[i]) & (4 * n[i] >= 3 * n[j])]
        j = j[7 * np.bitwise_count(bits_[j] ^ bits_[i]).sum(axis=1, dtype=np.int64) <= n[j] + n[i]]
        a.append(np.minimum(cid[i], cid[j]))
        b.append(np.maximum(cid[i], cid[j]))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def large_pairs(hot: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of large keys among classes that have too few other parts.

    Such a class has ``parts`` filled parts, ``hot`` of them in large keys, and
    may differ in ``most``. A pair without a shared small key shares at least
    parts - most large ones, so the first hot - (parts - most) + 1 of each (in
    the order of the keys' hashes) hold a common one: only those are compared.
    Members of one component are not compared with each other, and a pair is
    compared by its first common key (as far as that is among the first HEAD of
    both; beyond, it may be given more than once)."""
    short = (classes.select("cid", "n", "sketch", F.explode("slack").alias("s")).select("cid", "n", "sketch", "s.*")
             .join(hot, ["scheme", "cid"]).where("parts - size(keys) <= most")
             .withColumn("ranked", F.expr("slice(array_sort(transform(keys, k -> struct(xxhash64(k) as rank, k as key))), 1, "
                                          "cast(size(keys) - greatest(parts - most, 1) + 1 as int))"))
             .join(roots, "cid", "left"))
    short = C.materialize(short.select("cid", "n", "sketch", F.coalesce("root", "cid").alias("root"), "ranked",
                                       F.expr(f"transform(slice(ranked, 1, {HEAD}), x -> x.rank)").alias("head")), "large")
    keys = short.select("cid", "n", "sketch", "root", "head", F.explode("ranked").alias("r")).select(
        "cid", "n", "sketch", "root", "head", "r.rank", "r.key")
    open_ = (keys.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    dealt = (keys.join(open_, "key")
             .withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("key", "rank", "cid", "n", "sketch", "head", "root", "block", F.least("block", "other").alias("lo"),
                     F.greatest("block", "other").alias("hi")))
    return dealt.groupBy("key", "lo", "hi").applyInPandas(block_pairs, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", small: int = SMALL) -> DataFrame:
    """no_id, doc_id, n_shingles, component_id (null for null ids) per row."""
    with C.small_batches(docs.sparkSession, ROWS):
        return _components(docs, id_col, text_col, small)


def _components(docs: DataFrame, id_col: str, text_col: str, small: int) -> DataFrame:
    d = docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                    F.col(text_col).alias("body"))
    sets = C.materialize(d.mapInArrow(C.lean(describe), SETS), "described")
    some = sets.where("n > 0")
    least = F.min_by(F.struct("no_id", "doc_id"), F.struct("no_id", "doc_id"))
    classes = C.materialize(some.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"),
                                                   F.first("slack").alias("slack"), least.alias("r"))
                            .select("cid", "n", "sketch", "slack", F.col("r.no_id").alias("rep_null"), F.col("r.doc_id").alias("rep")),
                            "classes")
    groups = C.materialize(candidate_groups(d, small=small), "groups")
    few = classes.where(F.exists("slack", lambda s: s["parts"] <= s["most"])).select("cid")
    if not few.isEmpty():                                    # sets with too few filled parts: keys of single shingles
        fine = C.materialize(candidate_groups(d, fine=True, small=small), "fine-groups")
        both = (fine.where("key is null").select("members", F.explode("members").alias("cid")).join(few, "cid")
                .select("cid", F.explode("members").alias("b")))
        keyed = C.materialize(large_keys(fine), "fine-keys").select(F.col("cid").alias("b"), F.explode("keys").alias("k"))
        extra = both.union(keyed.join(few.withColumnRenamed("cid", "b"), "b").select(F.col("b").alias("cid"), "k")
                           .join(keyed, "k").select("cid", "b")).where("cid <> b")
        few_pairs = extra.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()
    else:
        few_pairs = None
    small, hot = groups.where("key is null").select("members").distinct(), large_keys(groups)
    star = groups.where("scheme = -1").select(F.col("key").alias("a"), F.explode("members").alias("b")).distinct()
    if few_pairs is not None:
        star = star.union(few_pairs).distinct()
    edges = linked(star, classes, d)
    roots = with_components(classes, edges)
    rest = C.materialize(pairs_of(small, roots).union(large_pairs(hot, classes, roots)).distinct(), "rest")
    if not rest.isEmpty():
        edges = edges.union(linked(rest, classes, d))
        roots = with_components(classes, edges)
    named = classes.join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "rep_null", "rep")
    # written, so that both sides of the next join are exchanges that may be split at a large component
    low = C.materialize(named.groupBy("root").agg(F.min(F.when(~F.col("rep_null"), F.col("rep"))).alias("low")), "low")
    answer = C.materialize(named.join(low, "root").select("cid", "low"), "answer")
    mine = some.join(answer, "cid").select("no_id", "doc_id", "n", "low")
    alone = sets.where("n = 0").select("no_id", "doc_id", "n", F.when(~F.col("no_id"), F.col("doc_id")).alias("low"))
    return mine.unionByName(alone).select("no_id", "doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.read(spark, sf_dir, "documents")).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE
    list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, cast(len(sh) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id
FROM n JOIN (SELECT id, min(low) AS component_id FROM r GROUP BY id) c ON c.id = n.doc_id
"""

QUERIES = {"op7_parity_sketch_join": op7_parity_sketch_join}
ORACLES = {"op7_parity_sketch_join": SQL}
