"""Secret scan: fixed rules, and a character network over every candidate.

The rules give the base spans. Every run of 16 or more characters of
``[A-Za-z0-9+/_.=-]`` that no rule covers wholly is a candidate; a small convolutional network (numpy)
reads it with its surroundings in windows of WINDOW characters (long candidates
in several, the highest counts). It is trained on labelled findings: rule
findings against candidates that no rule touches, with the keyword hidden in
half of the positives. As rules find keys of few shapes, keys of other shapes
are planted in the surroundings of other candidates, and candidates that look
random are no negatives. A held-out part of the windows calibrates the scores
(Platt) and sets the threshold: the highest one that keeps RECALL of held-out
findings and of each of several shapes never fitted on. Candidates at or above it become spans
of kind ``cnn``; base spans always stay.

The network is fitted on every different window. Up to FIT_ROWS a label they
are one block; more are dealt into blocks by a hash (windows of the rarer label
into several, so that no block lacks them). In each epoch every block takes the
network of the epoch before through its own windows, and the networks of all
blocks are averaged by their windows. Logits are numbers of 1 / STEPS, so the
held-out windows of all blocks are counted by logit for the threshold.

Edge cases: null text is empty; without findings or without other candidates
nothing is added; repeated rows are scanned each; a null doc_id
is passed through; an empty table gives an empty result; other columns are not
read. Offsets count code points, ends are exclusive.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")                       # equals runs of any length with the short ones dropped
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "cnn")

BEFORE, BODY, AFTER = 24, 48, 16
WINDOW = BEFORE + BODY + AFTER
FIT_ROWS = 2000            # windows of the commoner label in a block
LEAST = 400                # windows of the rarer label in a block, if there are as many
STEPS = 1024               # logits are whole numbers of 1 / STEPS, at most LIMIT
LIMIT = 30
BLOCKS_READ = 8            # blocks of an Arrow batch
RECALL = 0.95
FILTERS, WIDTH, EMBED = 24, 5, 8
EPOCHS, RATE, SEED = 6, 0.01, 7


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base) -> list[tuple[int, int, bool | None]]:
    """(start, end, is a finding): values of the rules, and the other runs;
    None for runs that a rule covers in part."""
    out, covered = [], []
    for s, kind, e in base:
        m = ASSIGN.match(text, s) if kind == 0 else None
        out.append((m.start(2) if m else s, e, True))
        covered.append((s, e))
    i, covered = 0, sorted(covered)
    for m in CANDIDATE.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        k, part, whole = i, False, False
        while k < len(covered) and covered[k][0] < m.end():
            part = part or m.start() < covered[k][1]
            whole = whole or covered[k][0] <= m.start() and m.end() <= covered[k][1]
            k += 1
        if not whole:
            out.append((m.start(), m.end(), None if part else False))
    return out


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(characters, first, last of the candidate in them) per window."""
    out = []
    for s in range(start, end, BODY):
        e = min(end, s + BODY)
        a = max(0, s - BEFORE)
        out.append((text[a:e + AFTER], s - a, e - a))
    return out


def codes(parts: list[tuple[str, int, int]]):
    """Character classes (n, WINDOW) with the candidate at a fixed place, and
    the mask of its characters."""
    x, inside = np.zeros((len(parts), WINDOW), np.uint8), np.zeros((len(parts), WINDOW), np.float32)
    for i, (t, a, b) in enumerate(parts):
        c = np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.uint8)
        at = BEFORE - a
        x[i, at:at + len(c)] = c
        inside[i, BEFORE:BEFORE + b - a] = 1
    return x, inside


class Network:
    """Embedding, one convolution, maximum over the window and over the
    candidate, one logistic unit."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": r.normal(0, 0.5, (128, EMBED)).astype(np.float32), "conv": f(WIDTH * (EMBED + 1), FILTERS),
                  "bias": np.zeros(FILTERS, np.float32), "out": f(2 * FILTERS, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x, inside):
        p = self.p
        e = np.concatenate([p["emb"][x], inside[:, :, None]], axis=2)
        n, k = len(x), WINDOW - WIDTH + 1
        cols = np.concatenate([e[:, i:i + k] for i in range(WIDTH)], axis=2)
        h = np.maximum(cols.reshape(n * k, -1) @ p["conv"] + p["bias"], 0).reshape(n, k, FILTERS)
        own = h * inside[:, WIDTH // 2:WIDTH // 2 + k, None]
        a, b = h.argmax(axis=1), own.argmax(axis=1)
        top = np.concatenate([np.take_along_axis(h, a[:, None], 1)[:, 0], np.take_along_axis(own, b[:, None], 1)[:, 0]], axis=1)
        return top @ p["out"] + p["b"][0], (e, cols, h, inside, a, b, top)

    def gradient(self, x, inside, y):
        z, (e, cols, h, _, a, b, top) = self.forward(x, inside)
        n, k = len(x), WINDOW - WIDTH + 1
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n).astype(np.float32)
        g = {"out": top.T @ d, "b": d.sum(keepdims=True)}
        dtop = d[:, None] * self.p["out"]
        dh = np.zeros_like(h)
        own = np.take_along_axis(inside[:, WIDTH // 2:WIDTH // 2 + k, None].repeat(FILTERS, 2), b[:, None], 1)[:, 0]
        i, j = np.arange(n)[:, None], np.arange(FILTERS)[None]
        np.add.at(dh, (i, a, j), dtop[:, :FILTERS])
        np.add.at(dh, (i, b, j), dtop[:, FILTERS:] * own)
        dh *= h > 0
        flat = dh.reshape(n * k, FILTERS)
        g["conv"] = cols.reshape(n * k, -1).T @ flat
        g["bias"] = flat.sum(axis=0)
        dcols = (flat @ self.p["conv"].T).reshape(n, k, WIDTH, EMBED + 1)[..., :EMBED]
        de = np.zeros((n, WINDOW, EMBED), np.float32)
        for w in range(WIDTH):
            de[:, w:w + k] += dcols[:, :, w]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], x.reshape(-1), de.reshape(-1, EMBED))
        return g

    def fit(self, x, inside, y, epochs=EPOCHS, rate=RATE, seed=SEED):
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
                t += 1
                for k, g in self.gradient(x[part], inside[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    def logits(self, x, inside) -> np.ndarray:
        z = np.concatenate([self.forward(x[i:i + 256], inside[i:i + 256])[0] for i in range(0, len(x), 256)] or [np.zeros(0)])
        return np.round(np.clip(z, -LIMIT, LIMIT) * STEPS) / STEPS

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling by Newton steps; ``n`` windows of each logit."""
        a, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            w = n * (p * (1 - p) + 1e-6)
            g = np.array([(n * (p - y) * z).sum() + 1e-3 * (a - 1), (n * (p - y)).sum() + 1e-3 * c])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(max(a, 1e-3)), float(c)

    def settle(self, counts: dict[str, dict[float, int]], recall: float = RECALL) -> None:
        """Calibration and threshold from held-out windows counted by logit:
        the sides that must be found, and "clean"."""
        rows = [(z, side != "clean", n) for side, part in sorted(counts.items()) for z, n in sorted(part.items())]
        z, y, n = (np.array(c, float) for c in zip(*rows))
        self.calibrate(z, y, n)
        lowest = []
        for side, part in counts.items():
            if side != "clean" and part:
                at, n = np.array(sorted(part)), np.array([part[k] for k in sorted(part)])
                lowest.append(at[np.searchsorted(np.cumsum(n), np.floor((1 - recall) * n.sum()), side="right")])
        self.threshold = float(self.probability(np.array([min(lowest)]))[0]) if lowest else 2.0

    def pack(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> "Network":
        at = 0
        for k in sorted(self.p):
            v = self.p[k]
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


# Shapes of keys (alphabet, least and most length, prefixes). Findings of the rules are of few shapes, so keys of
# others are drawn; shapes of the second list are never fitted on, they hold the threshold down to their recall.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FIT_SHAPES = [(LOWER + UPPER + DIGITS, 16, 64, ("",)), (DIGITS + "ABCDEF", 24, 64, ("",)), (LOWER + DIGITS, 20, 48, ("",)),
              (LOWER + UPPER + DIGITS + "+/", 24, 64, ("",)), (LOWER + UPPER + DIGITS, 20, 40, ("k_", "key-", "tk_", "live_"))]
HELD_SHAPES = [(LOWER + UPPER + DIGITS, 24, 40, ("ghp_", "xoxb-", "sk-")), (UPPER + "234567", 26, 52, ("",)),
               (LOWER + UPPER + DIGITS + "-_", 32, 43, ("",)), (DIGITS + "abcdef", 32, 40, ("",))]


def draw_key(shape, draw) -> str:
    alphabet, low, high, prefixes = shape
    body = "".join(alphabet[k] for k in draw.integers(0, len(alphabet), int(draw.integers(low, high + 1))))
    return prefixes[int(draw.integers(len(prefixes)))] + body


def planted(window: tuple[str, int, int], key: str) -> tuple[str, int, int]:
    """A window's surroundings with a key in place of its candidate."""
    t, a, b = window
    return windows(t[:a] + key + t[b:], a, a + len(key))[0]


def looks_random(s: str) -> bool:
    """Letters, capitals and digits in turn: such a candidate may be a bare
    secret, and says nothing of what is none."""
    kinds = [2 if c.isdigit() else 1 if c.isupper() else 0 for c in s if c.isalnum()]
    turns = sum(x != y for x, y in zip(kinds, kinds[1:]))
    return len(kinds) >= 12 and turns >= 0.25 * (len(kinds) - 1)


def sides_of(found: list, other: list, aside_found: list, aside_other: list, seed: int = SEED):
    """What a block's windows give: positives and negatives to fit on, and the
    held-out sides. Keys of FIT_SHAPES are planted in the surroundings of other
    candidates to be fitted on, keys of HELD_SHAPES in held-out ones."""
    draw = np.random.default_rng(seed)

    def plain(part):
        return [w for w in part if not looks_random(w[0][w[1]:w[2]])]

    def hidden(part):
        return [(t[a:], 0, b - a) if i % 2 else (t, a, b) for i, (t, a, b) in enumerate(part)]
    drawn = [planted(w, draw_key(FIT_SHAPES[i % len(FIT_SHAPES)], draw)) for i, w in enumerate(other * (1 + 400 // max(1, len(other))))]
    sides = {"found": hidden(aside_found), "clean": plain(aside_other) or aside_other}
    for k, shape in enumerate(HELD_SHAPES):
        sides[str(k)] = [planted(w, draw_key(shape, draw)) for w in aside_other * (1 + 100 // max(1, len(aside_other)))]
    return hidden(found) + drawn, plain(other) or other, sides


def arrays(positive: list, negative: list):
    """Codes and labels; the rarer label's windows are seen more often."""
    most = max(len(positive), len(negative))
    parts = [[group[k % len(group)] for k in range(most)] for group in (positive, negative)]
    return (*codes(parts[0] + parts[1]), np.repeat([1.0, 0.0], most).astype(np.float32))


def counted(net: Network, sides: dict) -> dict[str, dict[float, int]]:
    """Held-out windows of each side by logit."""
    out = {}
    for side, part in sides.items():
        z, n = np.unique(net.logits(*codes(part)).astype(np.float64), return_counts=True) if part else ((), ())
        out[side] = dict(zip(map(float, z), map(int, n)))
    return out


def train(found: list[tuple[str, int, int]], other: list[tuple[str, int, int]]) -> Network | None:
    """Network of one block of windows of findings and of other candidates;
    every fifth window is held out. The threshold keeps RECALL of the held-out
    findings and of each held shape."""
    if len(found) < 5 or len(other) < 5:
        return None
    kept, aside = ([[w for i, w in enumerate(part) if (i % 5 == 4) == held] for part in (found, other)] for held in (False, True))
    positive, negative, sides = sides_of(*kept, *aside)
    net = Network()
    net.fit(*arrays(positive, negative))
    net.settle(counted(net, sides))
    return net


SCAN = ("doc_id long, base array<struct<s:long,k:int,e:long>>, "
        "cand array<struct<s:long,e:long,found:boolean,parts:array<struct<t:string,a:int,b:int>>>>")


def scan(batches):
    kind = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
    part = pa.struct([("t", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
    cand = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("found", pa.bool_()), ("parts", pa.list_(part))]))
    for b in batches:
        bases, cands = [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            bases.append([{"s": s, "k": k, "e": e} for s, k, e in base])
            cands.append([{"s": s, "e": e, "found": f, "parts": [{"t": t, "a": x, "b": y} for t, x, y in windows(text, s, e)]}
                          for s, e, f in candidates(text, base)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, kind), pa.array(cands, cand)], ["doc_id", "base", "cand"])


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def decide(net: Network | None):
    """Scores the candidates of each row and writes the spans."""
    def run(batches):
        for b in batches:
            ids, base, cand = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            open_ = [(i, c) for i, cs in enumerate(cand) for c in cs if not c["found"]] if net else []
            parts = [(p["t"], p["a"], p["b"]) for _, c in open_ for p in c["parts"]]
            score = net.probability(np.concatenate([net.logits(*codes(parts[k:k + 4096])) for k in range(0, len(parts), 4096)]
                                                   or [np.zeros(0)]).astype(np.float64)) if net else []
            added: dict[int, list] = {}
            k = 0
            for i, c in open_:
                n = len(c["parts"])
                if score[k:k + n].max() >= net.threshold:
                    added.setdefault(i, []).append((c["s"], 3, c["e"]))
                k += n
            rows = []
            for i, spans in enumerate(base):
                own = [(x["s"], x["k"], x["e"]) for x in spans]
                more = added.get(i, [])
                rows.append((*(sum(x[1] == k for x in own) for k in range(3)), hashlib.sha256(digest(own).encode()).hexdigest(),
                             digest(own + more), len(more)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             [x.split()[0] for x in RESULT.split(", ")])
    return run


def different(scanned: DataFrame) -> DataFrame:
    """First windows of the candidates of both labels, each different one once."""
    return (scanned.select(F.explode("cand").alias("c")).where("c.found is not null")
            .select(F.col("c.found").alias("found"), F.element_at("c.parts", 1).alias("p")).select("found", "p.*").distinct())


def block_windows(block: pa.StructScalar):
    """(found, other, held-out found, held-out other, seed) of a block. A window
    in several blocks is held out in the first of them only."""
    parts = [[], [], [], []]
    for r in sorted(block["rows"].as_py(), key=lambda r: (r["h"], r["t"], r["a"], r["b"])):
        if not r["aside"] or not r["copy"]:
            parts[2 * r["aside"] + (not r["found"])].append((r["t"], r["a"], r["b"]))
    return *parts, SEED + block["block"].as_py()


def epoch(flat: np.ndarray, number: int):
    """Weighted sum of the networks of a task's blocks after one epoch; the
    weights stand last."""
    def run(batches):
        total = np.zeros(len(flat) + 1)
        for batch in batches:
            for block in batch.to_struct_array():
                *parts, seed = block_windows(block)
                positive, negative, _ = sides_of(*parts, seed)
                if positive and negative:
                    net = Network().unpack(flat)
                    net.fit(*arrays(positive, negative), epochs=1, seed=seed + 1000 * number)
                    n = len(parts[0]) + len(parts[1])
                    total += np.append(net.pack(), 1.0) * n
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])
    return run


def count_held(flat: np.ndarray):
    """Held-out windows of a task's blocks by side and logit."""
    def run(batches):
        net = Network().unpack(flat)
        for batch in batches:
            for block in batch.to_struct_array():
                *parts, seed = block_windows(block)
                rows = [(side, z, n) for side, part in counted(net, sides_of(*parts, seed)[2]).items() for z, n in part.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.int64()))],
                                                     ["side", "z", "n"])
    return run


def fit(scanned: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """Network from all different windows of a written table of scanned rows."""
    rows = C.materialize(different(scanned), "windows")
    sizes = {True: 0, False: 0} | {r[0]: r[1] for r in rows.groupBy("found").count().collect()}
    if max(sizes.values()) <= fit_rows:                      # one block, and it is whole
        got = rows.orderBy(F.xxhash64("t"), "t", "a", "b").collect()
        return train(*([(r["t"], r["a"], r["b"]) for r in got if r["found"] == f] for f in (True, False)))
    if min(sizes.values()) < 5:
        return None
    code = F.xxhash64("t", "a", "b")
    dealt = C.deal(rows.withColumn("h", code).withColumn("aside", F.pmod(F.xxhash64("h"), F.lit(5)) == 4), F.col("found"), code, sizes,
                   fit_rows, LEAST)
    with C.small_batches(rows.sparkSession, BLOCKS_READ):
        blocks = C.materialize(dealt.repartition(C.partitions(rows.sparkSession), "block").groupBy("block").agg(F.collect_list(F.struct("h", "t", "a", "b", "found", "aside", "copy")).alias("rows")),
                               "blocks")
        flat = Network().pack()
        for k in range(EPOCHS):
            sums = C.added(blocks.mapInArrow(epoch(flat, k), "sums array<double>"))
            if not sums[-1]:
                return None
            flat = np.round(sums[:-1] / sums[-1], 7)         # sums come in any order
        got = (blocks.mapInArrow(count_held(flat), "side string, z double, n long").groupBy("side", "z").agg(F.sum("n").alias("n"))
               .collect())                                   # at most 2 * LIMIT * STEPS + 1 rows a side
    counts: dict[str, dict[float, int]] = {}
    for r in got:
        counts.setdefault(r["side"], {})[r["z"]] = r["n"]
    net = Network().unpack(flat)
    net.settle(counts)
    return net


def find_secrets(docs: DataFrame, id_col="doc_id", text_col="text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Spans of every row: see RESULT."""
    rows = C.materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
                         .mapInArrow(scan, SCAN), "scanned")
    return rows.mapInArrow(decide(fit(rows, fit_rows)), RESULT)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(C.read(spark, sf_dir, "documents"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES: dict[str, str] = {}
