"""Repeated-substring removal by prefix-free parsing.

Every byte covered by a 100-byte string that also starts earlier in the corpus
(by doc_id, then position) is removed; strings don't cross documents.

Parsing: a rolling hash of GRAM bytes is a trigger where it is the least of a
window's hashes, so every 100-byte string holds the trigger it belongs to, and
equal strings hold the same one. The strings of one trigger form a phrase (the
bytes they cover), so phrases overlap by less than a string and parse every
document. Phrases meet by trigger: a phrase of equal content that starts
earlier makes all strings of the later one repeats, wherever it is, so the
dictionary keeps first occurrences only. What is left are the strings near the
edges of repeats, in dictionary phrases that share a trigger but not their
content. The suffixes of those phrases (their 100-byte strings) are sorted
within the trigger, and the first occurrence of each in corpus order (from the
parse) stays. Triggers with more than MANY different phrases, as a very common
line has, deal their strings out by 128 bits of hash, so no group of rows of
unbounded size meets in one task. Copies are combined within each input task
before anything is shuffled.

Edge cases: null text is empty; texts under 100 bytes stay whole; a null
doc_id comes after all others; rows that repeat a doc_id with other texts, and
rows of null ids, are ordered by a hash of the text, whose keys are checked to
differ; rows that repeat id and text are one document
and get the same result each; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
GRAM = 40                  # bytes of a trigger
PIECE = 1 << 20            # bytes hashed at once; longer texts are parsed in pieces that overlap
FLUSH = 400_000            # phrases a task holds before it passes them on
MANY = 256                 # different phrases of a trigger that are sorted together
POS = np.uint64((1 << 21) - 1)
NO_ID = np.uint64(62)      # the bit of a row key that marks null ids; below it, bits of a hash of the text
TIE_BITS = 62
BASE, OTHER = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tables(base: int = BASE):
    """Byte values, powers of the base and of its inverse (mod 2**64)."""
    if base not in _tables:
        inverse = pow(base, -1, 1 << 64)
        n = 2 * PIECE + 2

        def powers(b):
            out = np.ones(n, np.uint64)
            out[1:] = np.uint64(b)
            return np.cumprod(out, dtype=np.uint64)
        _tables[base] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)), powers(base), powers(inverse)
    return _tables[base]


def prefix_hash(buf: np.ndarray, base: int = BASE) -> np.ndarray:
    byte, up, _ = tables(base)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[buf] * up[:len(buf)], dtype=np.uint64)])


def range_hash(pre: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = BASE) -> np.ndarray:
    return mix((pre[b] - pre[a]) * tables(base)[2][a])


def phrases(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Phrases of the pieces that end at ``ends`` in one buffer of bytes:
    first string, number of strings, trigger hash, content hash, and the
    prefix hashes."""
    pre = prefix_hash(buf)
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), pre
    at = np.arange(n - gram + 1)
    h = range_hash(pre, at, at + gram)
    m = (h & ~POS) | at.astype(np.uint64)                    # leftmost of equal hashes wins
    wide, span = length - gram + 1, 1
    while span * 2 <= wide:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if wide > span:
        m = np.minimum(m[:len(m) - (wide - span)], m[wide - span:])
    starts = np.concatenate([[0], ends[:-1]])
    count = np.maximum(0, ends - starts - length + 1)
    p = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if not len(p):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), pre
    trigger = (m[p] & POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (p[1:] != p[:-1] + 1)]))
    first = p[new]
    size = np.diff(np.append(new, len(p)))
    trigger = trigger[new]
    shape = ((trigger - first).astype(np.uint64) << np.uint64(8)) | size.astype(np.uint64)
    content = mix(range_hash(pre, first, first + size - 1 + length) ^ mix(shape))
    return first, size, h[trigger], content, pre


def pieces(docs):
    """Groups of (document index, offset, bytes) of at most about PIECE bytes;
    every string of a document lies in exactly one of its pieces."""
    group, size = [], 0
    for i, body in enumerate(docs):
        for o in range(0, max(1, len(body) - LENGTH + 1), PIECE - LENGTH + 1):
            part = body[o:o + PIECE]
            if size + len(part) > PIECE and group:
                yield group
                group, size = [], 0
            group.append((i, o, part))
            size += len(part)
    if group:
        yield group


def parsed(bodies):
    """Arrays per group of pieces: document index, first string in the
    document, strings, trigger, content, first in the buffer, buffer, prefix."""
    for group in pieces(bodies):
        buf = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in group])
        first, size, trigger, content, pre = phrases(buf, ends)
        k = np.searchsorted(ends, first, side="right")
        doc = np.array([i for i, _, _ in group], np.int64)
        shift = np.array([o for _, o, _ in group], np.int64) - np.concatenate([[0], ends[:-1]])
        yield doc[k], first + shift[k], size, trigger, content, first, buf, pre


# --- columns that travel between tasks: documents run-length coded, the rest flat

KINDS = {"doc": np.int64, "tie": np.uint64, "start": np.uint32, "count": np.uint8, "status": np.uint8, "key": np.uint64,
         "content": np.uint64}
SENT = "pid int, kind int, docs binary, ties binary, runs binary, start binary, count binary, status binary, key binary, content binary, bytes binary"


def send(pid: np.ndarray, kind: int, cols: dict, body: tuple | None = None):
    """One row per reduce partition. ``body`` = (bytes, offsets) per record."""
    order = np.argsort(pid, kind="stable")
    pid = pid[order]
    cols = {k: np.ascontiguousarray(v[order], KINDS[k]) for k, v in cols.items()}
    at = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]])) if len(pid) else []
    rows = []
    for a, b in zip(at, [*at[1:], len(pid)]):
        d, t = cols["doc"][a:b], cols["tie"][a:b]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        text = None
        if body is not None:
            lo, hi = body[1][:-1][order[a:b]], body[1][1:][order[a:b]]
            text = b"".join(body[0][x:y] for x, y in zip(lo.tolist(), hi.tolist()))
        rows.append((int(pid[a]), kind, d[new].tobytes(), t[new].tobytes(), np.diff(np.append(new, b - a)).astype(np.uint32).tobytes(),
                     *(cols[k][a:b].tobytes() if k in cols else None for k in ("start", "count", "status", "key", "content")), text))
    if rows:
        c = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.binary()) for x in c[2:])],
                                         [x.split()[0] for x in SENT.split(", ")])


def received(batches) -> dict:
    """kind -> columns of all rows of a partition."""
    got: dict = {}
    for b in batches:
        for row in zip(*b.columns[1:]):
            parts = got.setdefault(row[0].as_py(), {})
            runs = np.frombuffer(row[3].as_buffer(), np.uint32)
            parts.setdefault("doc", []).append(np.repeat(np.frombuffer(row[1].as_buffer(), np.int64), runs))
            parts.setdefault("tie", []).append(np.repeat(np.frombuffer(row[2].as_buffer(), np.uint64), runs))
            for k, v in zip(("start", "count", "status", "key", "content"), row[4:9]):
                if v.is_valid:
                    parts.setdefault(k, []).append(np.frombuffer(v.as_buffer(), KINDS[k]))
            if row[9].is_valid:
                parts.setdefault("bytes", []).append(row[9].as_py())
    return {kind: {k: b"".join(v) if k == "bytes" else np.concatenate(v) for k, v in parts.items()} for kind, parts in got.items()}


def pick(cols: dict, sel) -> dict:
    return {k: v[sel] for k, v in cols.items() if k != "bytes"}


def corpus_order(c: dict, *keys) -> np.ndarray:
    """Sorted by keys, then null ids last, doc_id, tie, position."""
    return np.lexsort((c["start"], c["tie"], c["doc"], c["tie"] >> NO_ID, *reversed([c[k] for k in keys])))


def equal_groups(*keys) -> np.ndarray:
    """Marks of the first of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    differ = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        differ |= k[1:] != k[:-1]
    return np.concatenate([[True], differ])


def occurrences(c: dict, *keys) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first occurrence of each key in corpus order and of the
    later ones. Records of equal (doc, tie, start) come from rows that repeat
    id and text: they are one occurrence, of which one record is returned."""
    order = corpus_order(c, *keys)
    by = [c[k][order] for k in keys]
    first = equal_groups(*by)
    later = equal_groups(*by, *(c[k][order] for k in ("doc", "tie", "start"))) & ~first
    return order[first], order[later]


def repeated(key: np.ndarray) -> np.ndarray:
    """Indexes of records whose key occurs more than once."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) else order


def to_doc(cols: dict, parts: int, status: int):
    """Rows that take marks to their document's partition."""
    pid = (mix(cols["doc"].astype(np.uint64) ^ mix(cols["tie"].astype(np.uint64))) % np.uint64(parts)).astype(np.int32)
    out = {k: cols[k] for k in ("doc", "tie", "start", "count")} | {"status": np.full(len(pid), status, np.uint8)}
    return send(pid, 1, out)


DOC = ["doc", "tie", "body"]


def rows_of(batch):
    """(doc, tie, bytes) lists of a batch of DOC columns."""
    return (batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64),
            batch.column(2).to_pylist())


def map_phrases(parts: int):
    """Round 1, per input task: first occurrence of each phrase to its
    trigger's partition (kind 0); the others are repeats already (kind 1)."""
    def flush(held):
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        kept, again = np.ones(len(c["doc"]), bool), np.zeros(len(c["doc"]), bool)
        dup = repeated(c["key"] ^ mix(c["content"]))
        first, later = occurrences(pick(c, dup), "key", "content")
        kept[dup] = False
        kept[dup[first]] = True
        again[dup[later]] = True
        one = pick(c, kept)
        yield from send((one["key"] % np.uint64(parts)).astype(np.int32), 0, one)
        yield from to_doc(pick(c, again), parts, 1)

    def run(batches):
        held, n = [], 0
        for b in batches:
            doc, tie, bodies = rows_of(b)
            for i, start, size, trigger, content, *_ in parsed(bodies):
                held.append({"doc": doc[i], "tie": tie[i], "start": start.astype(np.uint32), "count": size.astype(np.uint8),
                             "key": trigger, "content": content})
                n += len(i)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)
    return run


def reduce_phrases(parts: int, many: int):
    """Round 1, per partition of triggers: repeats of phrases (status 1), and
    dictionary phrases whose trigger has others (2; 3 if it has very many)."""
    def run(batches):
        got = received(batches)
        if 1 in got:
            yield from to_doc(got[1], parts, 1)
        if 0 not in got:
            return
        c = got.pop(0)
        c = pick(c, repeated(c["key"]))
        first, later = occurrences(c, "key", "content")
        yield from to_doc(pick(c, later), parts, 1)
        c = pick(c, first)
        new = equal_groups(c["key"])
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        size = np.repeat(size, size)
        yield from to_doc(pick(c, (size > 1) & (size <= many)), parts, 2)
        yield from to_doc(pick(c, size > many), parts, 3)
    return run


MARKS = "doc long, tie long, start binary, count binary, status binary, open boolean"


def merge_marks(batches):
    """All marks of a document, by position."""
    got = received(batches)
    if not got:
        return
    [c] = got.values()
    c = pick(c, corpus_order(c))
    new = np.flatnonzero(equal_groups(c["doc"], c["tie"]))
    for i in range(0, len(new), 4096):
        part = new[i:i + 4096]
        ends = np.append(new[i + 1:i + 4097], len(c["doc"]))[:len(part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c["doc"][part]), pa.array(c["tie"][part].astype(np.int64)),
             *(pa.array([c[k][a:b].tobytes() for a, b in zip(part, ends)], pa.binary()) for k in ("start", "count", "status")),
             pa.array([bool((c["status"][a:b] > 1).any()) for a, b in zip(part, ends)])],
            [x.split()[0] for x in MARKS.split(", ")])


def map_strings(parts: int):
    """Round 2: dictionary phrases that share a trigger go there with their
    bytes (kind 0); strings of very common triggers go by two 64-bit hashes
    of different bases (kind 2)."""
    def common(held):
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        first, later = occurrences(c, "key", "content")
        one = pick(c, first)
        yield from send((one["key"] % np.uint64(parts)).astype(np.int32), 2, one)
        yield from to_doc(pick(c, later), parts, 1)

    def run(batches):
        held, n = [], 0
        seen: set = set()                                    # one of the rows that repeat id and text is enough
        for b in batches:
            new = []
            for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new.append(k not in seen)
                seen.add(k)
            b = b.filter(pa.array(new, pa.bool_()))
            doc, tie, bodies = rows_of(b)
            marks = [dict(zip(np.frombuffer(s, np.uint32).tolist(), np.frombuffer(t, np.uint8).tolist()))
                     for s, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            for i, start, size, trigger, _, at, buf, pre in parsed(bodies):
                status = np.fromiter((marks[d].get(s, 0) for d, s in zip(i.tolist(), start.tolist())), np.int64, len(i))
                two, three = np.flatnonzero(status == 2), np.flatnonzero(status == 3)
                if len(two):
                    raw = buf.tobytes()
                    text = [raw[a:a + k + LENGTH - 1] for a, k in zip(at[two].tolist(), size[two].tolist())]
                    yield from send((trigger[two] % np.uint64(parts)).astype(np.int32), 0,
                                    {"doc": doc[i[two]], "tie": tie[i[two]], "start": start[two], "count": size[two], "key": trigger[two]},
                                    (b"".join(text), np.concatenate([[0], np.cumsum([len(t) for t in text])])))
                if len(three):
                    k = size[three]
                    inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    p = np.repeat(at[three], k) + inner
                    held.append({"doc": np.repeat(doc[i[three]], k), "tie": np.repeat(tie[i[three]], k),
                                 "start": (np.repeat(start[three], k) + inner).astype(np.uint32), "count": np.ones(len(p), np.uint8),
                                 "key": range_hash(pre, p, p + LENGTH),
                                 "content": range_hash(prefix_hash(buf, OTHER), p, p + LENGTH, OTHER)})
                    n += len(p)
                    if n >= FLUSH:
                        yield from common(held)
                        held, n = [], 0
        if held:
            yield from common(held)
    return run


def later_strings(c: dict) -> dict:
    """Marks of the strings of dictionary phrases that occur earlier, from the
    sorted suffixes (first 100 bytes) of the phrases of each trigger."""
    buf = np.frombuffer(c["bytes"], np.uint8)
    size = c["count"].astype(np.int64)
    at = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    order = np.argsort(c["key"], kind="stable")
    found = []
    new = np.flatnonzero(equal_groups(c["key"][order]))
    ends = np.append(new[1:], len(order))
    lo = 0
    while lo < len(new):                                     # as many triggers at a time as fit
        hi, n = lo, 0
        while hi < len(new) and (n == 0 or n < 200_000):
            n += int(size[order[new[hi]:ends[hi]]].sum())
            hi += 1
        own = order[new[lo]:ends[hi - 1]]
        k = size[own]
        inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        p = np.repeat(at[own], k) + inner
        s = np.empty((len(p), LENGTH + 8), np.uint8)
        s[:, :8] = np.repeat(c["key"][own], k).astype(">u8").view(np.uint8).reshape(-1, 8)
        s[:, 8:] = buf[p[:, None] + np.arange(LENGTH)]
        suffix = s.reshape(-1).view(f"S{LENGTH + 8}")
        _, rank = np.unique(suffix, return_inverse=True)
        w = {"rank": rank, "doc": np.repeat(c["doc"][own], k), "tie": np.repeat(c["tie"][own], k),
             "start": (np.repeat(c["start"][own], k) + inner).astype(np.uint32)}
        found.append(pick(w, occurrences(w, "rank")[1]))
        lo = hi
    out = {k: np.concatenate([f[k] for f in found]) for k in ("doc", "tie", "start")}
    return out | {"count": np.ones(len(out["doc"]), np.uint8)}


def reduce_strings(parts: int):
    def run(batches):
        got = received(batches)
        if 1 in got:
            yield from to_doc(got[1], parts, 1)
        if 0 in got:
            yield from to_doc(runs(later_strings(got[0])), parts, 1)
        if 2 in got:
            c = got[2]
            yield from to_doc(runs(pick(c, occurrences(c, "key", "content")[1])), parts, 1)
    return run


def runs(c: dict) -> dict:
    """Single strings in a row as one mark (of at most 255)."""
    if not len(c["doc"]):
        return c
    c = pick(c, corpus_order(c))
    start = c["start"].astype(np.int64)
    new = np.concatenate([[True], (c["doc"][1:] != c["doc"][:-1]) | (c["tie"][1:] != c["tie"][:-1]) | (start[1:] != start[:-1] + 1)])
    at = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(at, np.diff(np.append(at, len(start))))
    new |= place % 255 == 0
    at = np.flatnonzero(new)
    out = pick(c, at)
    out["count"] = np.diff(np.append(at, len(start))).astype(np.uint8)
    return out


def spans_of(start: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Merged byte ranges (lo, hi) of strings start .. start+count-1."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    lo = start[order].astype(np.int64)
    hi = np.maximum.accumulate(lo + count[order].astype(np.int64) - 1 + length)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    at = np.flatnonzero(new)
    return np.stack([lo[at], hi[np.append(at[1:], len(lo)) - 1]], axis=1)


RESULT = "doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_spans(keep_text: bool):
    def run(batches):
        for b in batches:
            doc, tie, bodies = rows_of(b)
            rows = []
            for body, s1, c1, t1, s2, c2 in zip(bodies, *(b.column(k).to_pylist() for k in range(3, 8))):
                start = [np.frombuffer(x or b"", np.uint32) for x in (s1, s2)]
                count = [np.frombuffer(x or b"", np.uint8) for x in (c1, c2)]
                sure = np.frombuffer(t1 or b"", np.uint8) == 1
                spans = spans_of(np.concatenate([start[0][sure], start[1]]), np.concatenate([count[0][sure], count[1]]))
                kept, at = [], 0
                for lo, hi in spans.tolist():
                    kept.append(body[at:lo])
                    at = hi
                kept = b"".join([*kept, body[at:]])
                rows.append((len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(tie.astype(np.int64)), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()),
                 pa.array(c[4], pa.binary())], [x.split()[0] for x in RESULT.split(", ")])
    return run


def row_keys(docs: DataFrame, id_col: str, text_col: str, bits: int = TIE_BITS) -> DataFrame:
    """(doc, tie, body): two rows have one key exactly if they have one id (or
    none) and one text. Null ids take the place of an id by a hash of their
    text. That different texts of one key don't exist is looked up by their
    SHA-256; if some do, the next hash is taken, of more bits if it had fewer
    than fit."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), body.alias("body"))
    for seed in range(64):
        mask = (1 << min(int(NO_ID), bits << seed)) - 1
        tie = F.xxhash64("body", F.lit(2 * seed)).bitwiseAND(F.lit(mask)) + F.when(F.col("no_id"), F.lit(1 << int(NO_ID))).otherwise(F.lit(0))
        other = F.xxhash64("body", F.lit(2 * seed + 1)).bitwiseAND(F.lit(mask))
        d = rows.select(F.when(F.col("no_id"), other).otherwise(F.col("id")).alias("doc"), tie.alias("tie"), "body")
        sha = d.select("doc", "tie", F.unhex(F.sha2("body", 256)).alias("sha"))
        if sha.groupBy("doc", "tie").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").isEmpty():
            return d
    raise RuntimeError("no hash tells the rows apart")


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", many: int = MANY, keep_text: bool = True,
                   tie_bits: int = TIE_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the
    remaining bytes of every row."""
    spark = docs.sparkSession
    parts = C.partitions(spark)
    d = row_keys(docs, id_col, text_col, tie_bits)

    def round_trip(sent: DataFrame, reducer) -> DataFrame:
        met = sent.repartitionById(parts, F.col("pid")).mapInArrow(C.lean(reducer), SENT)
        return met.repartitionById(parts, F.col("pid")).mapInArrow(C.lean(merge_marks), MARKS)

    marks = C.materialize(round_trip(d.mapInArrow(C.lean(map_phrases(parts)), SENT), reduce_phrases(parts, many)), "phrases")
    left = d.join(marks.where("open").select("doc", "tie", "start", "status"), ["doc", "tie"]).select(*DOC, "start", "status")
    more = C.materialize(round_trip(left.mapInArrow(C.lean(map_strings(parts)), SENT), reduce_strings(parts)), "strings")
    every = (marks.select("doc", "tie", "start", "count", "status")
             .join(more.select("doc", "tie", F.col("start").alias("start2"), F.col("count").alias("count2")), ["doc", "tie"], "left"))
    out = (d.join(every, ["doc", "tie"], "left").select(*DOC, "start", "count", "status", "start2", "count2")
           .mapInArrow(C.lean(cut_spans(keep_text)), RESULT))
    return out.select(F.when(F.col("tie") < 1 << int(NO_ID), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                      *(["kept"] if keep_text else []))


def op10_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.read(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op10_prefix_free_dedup": op10_prefix_free_dedup}
ORACLES: dict[str, str] = {}
