"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of documents in ascending doc_id order. Ids are cut into
blocks of 128, across documents; a block stores its minimum, the differences
packed at a width that a percentile of them fits, and the rest as exceptions
(position, high bits). 8192 blocks make a section with columns of minima,
widths, exception counts and block starts, so any id range is read without
decoding what lies before it. Layout, little-endian:

    "PFR1" | sections | document table | footer
    section: n_ids u32, blocks u32, words u32, exceptions u32, minima u32[], start of each
             block in the words u32[], exceptions before each block u32[], widths u8[],
             words u64[], exception positions u8[], exception high bits u32[]
    document table: ids i64[], null marks u8[], ids before each document in the file u64[n + 1]
    footer: section offsets u64[], ids before each section u64[], then sections u64,
            documents u64, table offset u64, "PFR1"

A range partitioning by doc_id gives each task one file; the manifest has one
row per file, and a file's first global position is the sum over the files
before it.

Edge cases: null text is empty (the end id alone); null ids sort first and
come back as null; rows that repeat an id are kept, ordered by a hash of their
text; an empty table gives no file and an empty result; other columns are not
read. A failed or repeated attempt writes a file of its own; only files named
by the committed manifest are read.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

MAGIC = b"PFR1"
BLOCK = 128
SECTION = 8192 * BLOCK
PERCENTILE = 90
END_ID = 2


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_words(low: np.ndarray, width: int) -> np.ndarray:
    """(m, 128) values below 2**width -> (m, 2*width) uint64 words."""
    v = np.ascontiguousarray(low.T.astype(np.uint64))
    words = np.zeros((2 * width, low.shape[0]), np.uint64)
    for j in range(BLOCK):
        k, s = divmod(j * width, 64)
        words[k] |= v[j] << np.uint64(s)
        if s + width > 64:
            words[k + 1] |= v[j] >> np.uint64(64 - s)
    return words.T


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        k, s = divmod(j * width, 64)
        v = w[k] >> np.uint64(s)
        if s + width > 64:
            v = v | (w[k + 1] << np.uint64(64 - s))
        out[j] = v & mask
    return out.T


def encode_section(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, np.int64)
    x[:n] = ids
    x[n:] = ids[-1] if n else 0
    x = x.reshape(blocks, BLOCK)
    low = x.min(axis=1)
    d = x - low[:, None]
    nth = max(0, -(-BLOCK * percentile // 100) - 1)
    width = bit_length(np.partition(d, nth, axis=1)[:, nth])
    high = d >> width[:, None]
    d &= (np.int64(1) << width[:, None]) - 1
    at, pos = np.nonzero(high)
    starts = np.concatenate([[0], np.cumsum(2 * width)])
    words = np.zeros(starts[-1], np.uint64)
    for w in np.unique(width):
        if w:
            sel = np.flatnonzero(width == w)
            words[starts[sel][:, None] + np.arange(2 * w)] = pack_words(d[sel], int(w))
    before = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=blocks))])
    return b"".join([struct.pack("<4I", n, blocks, len(words), len(at)), low.astype("<u4").tobytes(),
                     starts[:-1].astype("<u4").tobytes(), before[:-1].astype("<u4").tobytes(),
                     width.astype("u1").tobytes(), words.astype("<u8").tobytes(), pos.astype("u1").tobytes(),
                     high[at, pos].astype("<u4").tobytes()])


def decode_section(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks [first, last) of a section (all by default)."""
    n, blocks, n_words, n_exc = struct.unpack_from("<4I", data)
    last = blocks if last is None else min(last, blocks)
    i = 16
    cols = []
    for kind, count in (("<u4", blocks), ("<u4", blocks), ("<u4", blocks), ("u1", blocks), ("<u8", n_words),
                        ("u1", n_exc), ("<u4", n_exc)):
        cols.append(np.frombuffer(data, kind, count, i))
        i += cols[-1].nbytes
    low, starts, before, width, words, pos, high = cols
    out = np.zeros((last - first, BLOCK), np.int64)
    for w in np.unique(width[first:last]):
        if w:
            sel = np.flatnonzero(width[first:last] == w)
            out[sel] = unpack_words(words[starts[first + sel][:, None].astype(np.int64) + np.arange(2 * int(w))], int(w))
    ends = np.concatenate([before[1:], [n_exc]]).astype(np.int64)
    a, b = (int(before[first]), int(ends[last - 1])) if last > first else (0, 0)
    at = np.repeat(np.arange(first, last), ends[first:last] - before[first:last]) - first
    out[at, pos[a:b]] |= high[a:b].astype(np.int64) << width[first + at].astype(np.int64)
    out += low[first:last, None].astype(np.int64)
    return out.reshape(-1)[:max(0, min(n, last * BLOCK) - first * BLOCK)].astype(np.uint32)


class Writer:
    def __init__(self, uri: str):
        f, p = C.open_fs(uri)
        self.out = f.open_output_stream(p)
        self.out.write(MAGIC)
        self.at, self.sections, self.firsts, self.n = 4, [], [], 0
        self.wait, self.waiting = [], 0
        self.ids, self.nulls, self.starts = [], [], [np.zeros(1, np.int64)]

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, off: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.nulls.append(nulls)
        self.starts.append(off[1:] + self.n + self.waiting)
        self.wait.append(ids)
        self.waiting += len(ids)
        while self.waiting >= SECTION:
            x = np.concatenate(self.wait)
            self._section(x[:SECTION])
            self.wait, self.waiting = [x[SECTION:]], len(x) - SECTION

    def _section(self, ids: np.ndarray) -> None:
        self.sections.append(self.at)
        self.firsts.append(self.n)
        data = encode_section(ids)
        self.out.write(data)
        self.at += len(data)
        self.n += len(ids)

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._section(np.concatenate(self.wait))
        docs = sum(map(len, self.ids))
        for x, kind in ((self.ids, "<i8"), (self.nulls, "u1"), (self.starts, "<u8"), ([self.sections], "<u8"),
                        ([self.firsts], "<u8")):
            for part in x:
                self.out.write(np.asarray(part).astype(kind).tobytes())
        self.out.write(struct.pack("<3Q4s", len(self.sections), docs, self.at, MAGIC))
        self.out.close()
        return docs, self.n


class Reader:
    def __init__(self, uri: str):
        f, p = C.open_fs(uri)
        self.file = f.open_input_file(p)
        size = self.file.size()
        n, docs, table, magic = struct.unpack("<3Q4s", self.file.read_at(28, size - 28))
        if magic != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        data = self.file.read_at(size - 28 - table, table)
        cols, i = [], 0
        for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs + 1), ("<u8", n), ("<u8", n)):
            cols.append(np.frombuffer(data, kind, count, i))
            i += cols[-1].nbytes
        self.doc_ids, nulls, starts, self.sections, self.firsts = cols
        self.nulls, self.starts = nulls.astype(bool), starts.astype(np.int64)
        self.ends = np.concatenate([self.sections[1:], [table]]).astype(np.int64)

    def section(self, k: int) -> bytes:
        a = int(self.sections[k])
        return self.file.read_at(int(self.ends[k]) - a, a)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids [a, b) of the file, by the section and block indexes."""
        out = []
        k = int(np.searchsorted(self.firsts, a, side="right")) - 1
        while a < b:
            first = int(self.firsts[k])
            lo = (a - first) // BLOCK
            got = decode_section(self.section(k), lo, -(-(b - first) // BLOCK))[a - first - lo * BLOCK:]
            got = got[:b - a]
            out.append(got)
            a, k = a + len(got), k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self):
        """(row, ids) in file order, each section decoded once."""
        k, have, first = 0, np.zeros(0, np.uint32), 0
        for row in range(len(self.doc_ids)):
            a, b = int(self.starts[row]), int(self.starts[row + 1])
            while first + len(have) < b:
                have = np.concatenate([have[max(0, a - first):], decode_section(self.section(k))])
                first, k = max(first, a), k + 1
            yield row, have[a - first:b - first]


MANIFEST = "shard int, uri string, n_docs long, n_ids long"
READ = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shard(path: str, folder: str, end_id: int):
    def run(batches):
        ctx = TaskContext.get()
        uri = f"{folder}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}.pfr"
        w = None
        for batch in batches:
            for b in T.slices(batch, 1):
                w = w or Writer(uri)
                ids, off = T.encode_with_end(path, b.column(1), end_id)
                w.add(b.column(0).fill_null(0).to_numpy(zero_copy_only=False),
                      b.column(0).is_null().to_numpy(zero_copy_only=False), ids, off)
        if w:
            docs, n = w.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ctx.partitionId()], pa.int32()), pa.array([uri]), pa.array([docs], pa.int64()),
                 pa.array([n], pa.int64())], ["shard", "uri", "n_docs", "n_ids"])
    return run


def read_shard(batches):
    for batch in batches:
        for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            r = Reader(uri)
            crc = np.fromiter((zlib.crc32(np.ascontiguousarray(ids, "<u4")) for _, ids in r.documents()), np.int64,
                              len(r.doc_ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(crc), shard, np.int32)), pa.array(r.doc_ids, mask=r.nulls),
                 pa.array(r.starts[:-1]), pa.array(np.diff(r.starts)), pa.array(crc)],
                ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, folder: str, id_col="doc_id", text_col="text", end_id: int = END_ID,
                      path: str | None = None) -> DataFrame:
    """Writes the files and returns the manifest (a written table)."""
    spark = docs.sparkSession
    C.make_dirs(folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return C.materialize(
        rows.repartitionByRange(C.partitions(spark), "doc_id", F.xxhash64("body"))
        .sortWithinPartitions("doc_id", F.xxhash64("body"))
        .mapInArrow(write_shard(path or T.vocabulary(), folder, end_id), MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, crc."""
    spark = manifest.sparkSession
    shards = sorted((r["shard"], r["uri"], r["n_ids"]) for r in manifest.collect())     # one row per file
    base, rows = 0, []
    for k, (_, uri, n) in enumerate(shards):
        rows.append((k, uri, base))
        base += n
    frame = spark.createDataFrame(rows, "shard int, uri string, base long")
    got = frame.repartitionById(max(1, len(rows)), F.col("shard")).select("shard", "uri").mapInArrow(read_shard, READ)
    return (got.join(F.broadcast(frame.select("shard", "base")), "shard")               # one row per file
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def op5_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "token-files")
    return read_token_files(write_token_files(C.read(spark, sf_dir, "documents"), folder))


QUERIES = {"op5_pfor_token_files": op5_pfor_token_files}
ORACLES: dict[str, str] = {}
