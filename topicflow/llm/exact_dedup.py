"""Exact dedup by Patricia-trie owners.

Texts that are equal after white-space normalisation form a group. Every
input task inserts its texts into a compressed radix trie and passes on one
row per distinct text (smallest id, count), so a group that holds a third of
all rows reaches its owner as one row per input task. The rows are
partitioned by (byte length, content hash); the owner of a partition inserts
the full byte strings into its trie, whose terminals keep the smallest id and
the count. Equality is decided by the bytes on the trie's paths.

Edge cases: null text counts as empty; a null id takes part in the count, and
is the kept id only when the whole group has null ids; rows that repeat both
id and text are one row to this operator: each carries the same decision; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TRIE_MB = 96          # bytes of keys a trie holds before it flushes (map side) or spills a subtree (owner)
OUT_ROWS = 2048


def normalised(text):
    """Column: runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), C.SPACE + "+", " ")


class Node:
    __slots__ = ("label", "kids", "low", "n")

    def __init__(self, label: bytes):
        self.label, self.kids, self.low, self.n = label, {}, None, 0


def common_prefix(a: bytes, i: int, b: bytes) -> int:
    """Length of the common prefix of a[i:] and b."""
    lo, hi = 0, min(len(a) - i, len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[i + lo:i + mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


class Trie:
    """Compressed radix trie over byte strings; a terminal (n > 0) holds the
    smallest id and the number of insertions. ``spill_at`` bytes of labels
    move the heaviest subtree below the first branching to a file opened by
    ``spill_open``; later keys with that prefix go to the same file."""

    def __init__(self, spill_at: int | None = None, spill_open=None):
        self.root, self.bytes = Node(b""), 0
        self.spill_at, self.spill_open, self.spilled = spill_at, spill_open, {}

    def insert(self, key: bytes, low, n: int) -> None:
        for prefix, f in self.spilled.items():
            if key.startswith(prefix):
                f.write(key, low, n)
                return
        node, i = self.root, 0
        while i < len(key):
            kid = node.kids.get(key[i])
            if kid is None:
                kid = node.kids[key[i]] = Node(key[i:])
                self.bytes += len(kid.label) + 200
                node, i = kid, len(key)
                break
            if key.startswith(kid.label, i):
                node, i = kid, i + len(kid.label)
                continue
            k = common_prefix(key, i, kid.label)            # split the edge
            mid = Node(kid.label[:k])
            mid.kids[kid.label[k]] = kid
            kid.label = kid.label[k:]
            node.kids[key[i]] = mid
            self.bytes += 200
            node, i = mid, i + k
        node.low = low if node.n == 0 else least(node.low, low)
        node.n += n
        if self.spill_at and self.bytes > self.spill_at:
            self._spill()

    def items(self, node=None, prefix: bytes = b""):
        """(key, smallest id, count) of every terminal held in memory."""
        stack = [(node or self.root, prefix)]
        while stack:
            x, p = stack.pop()
            p = p + x.label
            if x.n:
                yield p, x.low, x.n
            stack.extend((k, p) for k in x.kids.values())

    def _weight(self, node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack.extend(x.kids.values())
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while len(node.kids) == 1:
            node = next(iter(node.kids.values()))
            prefix += node.label
        if not node.kids:                                    # a single key cannot be divided
            return
        first, kid = max(node.kids.items(), key=lambda kv: self._weight(kv[1]))
        weight = self._weight(kid)
        out = self.spill_open()
        for key, low, n in self.items(kid, prefix):
            out.write(key, low, n)
        del node.kids[first]
        self.bytes -= weight
        self.spilled[prefix + bytes([first])] = out

    def drain(self):
        """All terminals; spilled subtrees are read back one at a time."""
        yield from self.items()
        self.root = Node(b"")
        for f in self.spilled.values():
            sub = Trie(self.spill_at, self.spill_open)
            for key, low, n in f.read():
                sub.insert(key, low, n)
            f.close()
            yield from sub.drain()


class SpillFile:
    """Length-prefixed records in the shared folder, removed after use."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{C.fresh('subtree')}"
        f, p = C.open_fs(self.uri)
        self.out = f.open_output_stream(p)

    def write(self, key, low, n):
        self.out.write(struct.pack("<Q?qq", len(key), low is not None, low or 0, n))
        self.out.write(key)

    def read(self):
        self.out.close()
        f, p = C.open_fs(self.uri)
        with f.open_input_stream(p, buffer_size=1 << 20) as s:
            size = struct.calcsize("<Q?qq")
            while head := s.read(size):
                length, has, low, n = struct.unpack("<Q?qq", head)
                yield s.read(length), low if has else None, n

    def close(self):
        C.remove(self.uri)


LOCAL_SCHEMA = "length long, hash long, body binary, low long, n long"
OWNER_SCHEMA = "text_sha256 string, keep_id long, group_size long"


def local_tries(budget: int):
    """Map side: one row per distinct text of a task (flushed by budget)."""
    def run(batches):
        import xxhash

        def rows(trie):
            out = []
            size = 0
            for key, low, n in trie.items():
                out.append((len(key), xxhash.xxh3_64_intdigest(key) - (1 << 63), key, low, n))
                size += len(key)
                if len(out) >= OUT_ROWS or size > 16 << 20:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

        def batch(out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["length", "hash", "body", "low", "n"])

        trie = Trie()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                trie.insert(t, i, 1)
                if trie.bytes > budget:
                    yield from rows(trie)
                    trie = Trie()
        yield from rows(trie)
    return run


def owner_tries(budget: int, folder: str):
    """Owner side: full byte strings of one partition, merged exactly."""
    def run(batches):
        trie = Trie(budget, lambda: SpillFile(folder))
        for b in batches:
            for key, low, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                trie.insert(key, low, n)
        out = []
        for key, low, n in trie.drain():
            out.append((hashlib.sha256(key).hexdigest(), low, n))
            if len(out) >= OUT_ROWS * 8:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
            ["text_sha256", "keep_id", "group_size"])
    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_mb: int = TRIE_MB) -> DataFrame:
    """One row per distinct normalised text: sha256, smallest id, group size."""
    spark = docs.sparkSession
    folder = C.scratch(spark, "trie")
    C.make_dirs(folder)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("body"))
    return (texts.mapInArrow(local_tries(trie_mb << 20), LOCAL_SCHEMA)
            .repartition(C.partitions(spark), "length", "hash")
            .mapInArrow(owner_tries(trie_mb << 20, folder), OWNER_SCHEMA))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, sha256."""
    own = C.materialize(owners(docs, id_col, text_col), "owners")
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    return (mine.join(own, "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def op3_patricia_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(C.read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""

QUERIES = {"op3_patricia_dedup": op3_patricia_dedup}
ORACLES = {"op3_patricia_dedup": SQL}
