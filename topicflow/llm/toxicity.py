"""Toxicity scores of deobfuscated text.

1. A character trigram model is counted over every text of the corpus.
2. Suspicious tokens (digits and signs among letters, letters doubled or drawn
   out, single letters set apart by marks or spaces) become lattices of the characters
   they may stand for; a Viterbi search under the trigram model with channel
   costs picks the restored word or words. Other tokens have one path and
   stay as they are, so only suspicious ones are searched.
3. A logistic regression over restored words, their beginnings and endings is
   fitted on a bounded sample of labelled rows and scores every whole text.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0;
labels, lang, source and doc_id are never inputs of a score. TRAIN_ROWS bounds
the labelled rows the regression is fitted on and FEATURES its width; corpus
counts and scores cover all rows and whole texts.

Edge cases: null and empty texts have no features and get the score of the
intercept; a null doc_id counts as the empty text in the crc; several labels
of one id count as toxic if any is, null labels and labels of unknown ids are
ignored; without labels of both kinds every score is the share of toxic labels
(0.0 without any); repeated rows are scored each; empty tables give an empty
result; other columns are not read.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

TRAIN_ROWS = 20_000        # labelled rows the regression may be fitted on
FEATURES = 1024            # words, beginnings and endings it may use
MIN_DOCS = 4               # labelled documents a feature must occur in
RIDGE = 0.05
LETTERS = 60               # letters of the trigram model; rarer ones share one symbol
CACHE_WORDS = 400_000
SLICE = 4 << 20            # bytes of text handled at once

# What a sign may stand for, and how much less likely that is than itself (log).
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
SIGN_COST, DROP_COST, BREAK_COST, ONCE_COST, TWICE_COST = -1.0, -0.7, -1.0, -0.2, -0.9
WILD, WILD_COST = "*#", -1.6   # may hide any vowel
MARKS = frozenset("._-*~'/")
EDGE = ".,;:!?\"'()[]{}<>|#%&*$=+-_/~\\"
ENDS = ".,;:?\"'()[]{}<>|"
SPACED = 4                 # single letters in a row that may be one spaced-out word


class Trigrams:
    """Interpolated character trigrams; index 0 is the word border, the last
    index stands for all other letters."""

    def __init__(self, letters: list[str], table: np.ndarray):
        self.at = {c: i + 1 for i, c in enumerate(letters)}
        self.letters, self.table = letters, table            # table[a][b][c] = log P(c | a, b)
        self.rows = table.tolist() if table.size <= 64 ** 3 else table

    @classmethod
    def fit(cls, counts: dict[str, int], most: int = LETTERS) -> "Trigrams":
        """From counts of 3-character strings over letters and the border ^."""
        single: dict[str, int] = {}
        for g, n in counts.items():
            if g[2] != "^":
                single[g[2]] = single.get(g[2], 0) + n
        letters = sorted(single, key=lambda c: (-single[c], c))[:most]
        at = {c: i + 1 for i, c in enumerate(letters)} | {"^": 0}
        n = len(letters) + 2
        c3 = np.zeros((n, n, n))
        for g, k in counts.items():
            c3[at.get(g[0], n - 1), at.get(g[1], n - 1), at.get(g[2], n - 1)] += k
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.1) / (c1.sum() + 0.1 * n)
        p2 = (c2 + 2 * p1) / (c2.sum(axis=1, keepdims=True) + 2)
        p3 = (c3 + 2 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 2)
        return cls(letters, np.log(p3).astype(np.float32))

    def index(self, c: str) -> int:
        return self.at.get(c, len(self.letters) + 1)


def runs(token: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in token:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def readings(c: str, n: int, spaced: bool) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, with log costs."""
    found = []
    if c.isalpha():
        letters = [(c, 0.0)]
    else:
        letters = [(x, SIGN_COST) for x in SIGNS.get(c, "")] + [(x, WILD_COST) for x in "aeiou" if c in WILD]
        if c in MARKS or c in WILD or not letters:
            found.append(("", DROP_COST))
            found.append(("^", BREAK_COST))
    for x, cost in letters:
        if n == 1:
            found.append((x, cost))
        elif n == 2:
            found += [(x + x, cost), (x, cost + TWICE_COST)]
        else:
            found += [(x, cost + ONCE_COST), (x + x, cost + TWICE_COST)]
    if not found:
        found.append(("", DROP_COST))
    return found


def viterbi(token: str, model: Trigrams, spaced: bool = False) -> str:
    """Best restored reading; words are separated by one space."""
    rows, index = model.rows, model.index
    states = {(0, 0): (0.0, None)}                           # (last two symbols) -> (score, (text, previous))
    for c, n in runs(token):
        options = [(s, cost, [0 if x == "^" else index(x) for x in s]) for s, cost in readings(c, n, spaced)]
        if spaced:
            options += [("^" + s, cost, [0, *ids]) for s, cost, ids in options if s and s[0] != "^"]
        new: dict = {}
        for (a, b), (score, back) in states.items():
            for s, cost, ids in options:
                p, q, total = a, b, score + cost
                for x in ids:
                    if x == 0:
                        if q == 0:
                            total = -math.inf                # no empty words
                            break
                        total += rows[p][q][0]
                        p, q = 0, 0
                    else:
                        total += rows[p][q][x]
                        p, q = q, x
                if total > -math.inf and ((p, q) not in new or total > new[p, q][0]):
                    new[p, q] = (total, (s, back) if s else back)
        states = new or states
    best = max(states.items(), key=lambda kv: kv[1][0] + (rows[kv[0][0]][kv[0][1]][0] if kv[0][1] else 0.0))
    parts, back = [], best[1][1]
    while back is not None:
        parts.append(back[0])
        back = back[1]
    return " ".join("".join(reversed(parts)).replace("^", " ").split())


def viterbi_letters(token: str, model: Trigrams) -> str:
    """``viterbi`` of a token of known letters only, where just the runs leave a
    choice: a state is the run before taken once or doubled, so there are two
    at most and the sums are the same."""
    rows, at = model.rows, model.at
    states = [(0, 0, 0.0, None)]                             # last two symbols, score, (text, previous)
    for c, n in runs(token):
        x = at[c]
        best = {}
        for a, b, score, back in states:
            if n <= 2:
                once = score + (0.0 if n == 1 else TWICE_COST)
                twice = score
            else:
                once, twice = score + ONCE_COST, score + TWICE_COST
            step = rows[a][b][x]
            once += step
            if n > 1:
                twice = twice + step + rows[b][x][x]
            if "1" not in best or once > best["1"][2]:
                best["1"] = (b, x, once, (c, back))
            if n > 1 and ("2" not in best or twice > best["2"][2]):
                best["2"] = (x, x, twice, (c + c, back))
        states = [best["1"]] if n == 1 else [best["2"], best["1"]] if n == 2 else [best["1"], best["2"]]
    parts, back = [], max(states, key=lambda s: s[2] + rows[s[0]][s[1]][0])[3]
    while back is not None:
        parts.append(back[0])
        back = back[1]
    return "".join(reversed(parts))


def core(token: str) -> str:
    """A token without marks at its ends (a single leading or trailing sign
    that may stand for a letter stays)."""
    t = token.strip(ENDS).rstrip("!")
    for side in (0, -1):
        while len(t) > 2 and t[side] in EDGE and t[side] == t[side + 1 if side == 0 else -2] \
                and (len(t) < 4 or t[side] == t[side + 2 if side == 0 else -3] or t[side] not in SIGNS):
            t = t.strip(t[side])
            break
    return t.strip(ENDS).rstrip("!")


def suspicious(t: str) -> bool:
    if len(t) < 3 or t.isalpha() and not any(n > 1 for _, n in runs(t)):
        return False
    letters = sum(c.isalpha() for c in t)
    return letters > 0 and (letters * 3 >= len(t) or any(c in MARKS for c in t))


DOUBLED = re.compile(r"(.)\1", re.S).search


def restored(token: str, model: Trigrams) -> tuple[str, ...]:
    t = token if token.isalpha() else core(token)            # letters have no marks at their ends
    if not t:
        return ()
    if t.isalpha():                                          # ``suspicious`` of letters
        if len(t) < 3 or not DOUBLED(t):
            return (t,)
        if model.at.keys() >= set(t):
            return (viterbi_letters(t, model),)
        return tuple(viterbi(t, model).split())
    return tuple(viterbi(t, model).split()) if suspicious(t) else (t,)


def doc_words(text: pa.Array, known: dict, make, model: Trigrams):
    """(values, rows): ``make(word)`` of every distinct token's restored words
    (cached in ``known`` by token), flattened, and the text each belongs to."""
    lower = pc.utf8_lower(text.fill_null(""))
    words = pc.ascii_split_whitespace(lower)
    first = words.offsets[0].as_py()
    flat = words.values.slice(first, words.offsets[-1].as_py() - first)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    if len(known) > CACHE_WORDS:
        known.clear()
    got = list(map(known.get, names))
    for k in [k for k, g in enumerate(got) if g is None]:
        w = names[k]
        known[w] = got[k] = tuple([v for r in restored(w, model) for v in make(r)])
    lens = np.fromiter(map(len, got), np.int64, len(got))
    values = [v for g in got for v in g]
    start = np.cumsum(lens) - lens
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    off = words.offsets.to_numpy(zero_copy_only=False) - first
    row = np.repeat(np.arange(len(text)), np.diff(off))
    some = lens[at] > 0 if len(at) else np.zeros(0, bool)
    n = lens[at[some]]
    pos = np.repeat(start[at[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    rows = np.repeat(row[some], n)
    # single letters in a row, set apart by spaces; marks around a letter don't end the row
    bare = pc.less_equal(pc.utf8_length(pc.utf8_trim(coded.dictionary, EDGE)), 1).to_numpy(zero_copy_only=False)
    letter = {k: names[k] if len(names[k]) == 1 else core(names[k]) for k in np.flatnonzero(bare).tolist()}
    single = np.zeros(len(names), bool)
    single[[k for k, c in letter.items() if len(c) == 1]] = True
    one = single[at]
    extra, extra_rows = [], []
    if one.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (one * (row + 1)), [0]])))
        a, b = edge[:-1], edge[1:]
        long = one[a] & (b - a >= SPACED)
        for a, b in zip(a[long].tolist(), b[long].tolist()):
            joined = "".join(letter[k] for k in at[a:b].tolist())
            for t in dict.fromkeys((joined, core(joined))):              # with and without lone marks at its ends
                for w in viterbi(t, model, True).split() if t else ():
                    got = make(w)
                    extra += got
                    extra_rows += [row[a]] * len(got)
    return values, pos, rows, extra, np.array(extra_rows, dtype=np.int64)


# --- 1. trigram counts of the whole corpus


def count_trigrams(batches):
    total: dict[str, int] = {}
    for batch in batches:
        for b in T.slices(batch, 0, SLICE):
            words = pc.ascii_split_whitespace(pc.utf8_lower(b.column(0).fill_null("")))
            first = words.offsets[0].as_py()
            flat = words.values.slice(first, words.offsets[-1].as_py() - first)
            flat = pc.utf8_trim(flat, ".,;:!?\"'()")
            flat = flat.filter(pc.utf8_is_alpha(flat))
            vc = flat.value_counts()
            if not len(vc):
                continue
            n = vc.field(1).to_numpy(zero_copy_only=False)
            names = vc.field(0)
            size = pc.utf8_length(names).to_numpy(zero_copy_only=False) + 3
            code = np.frombuffer(("^^" + "^^^".join(names.to_pylist()) + "^").encode("utf-32-le"), np.uint32).astype(np.int64)
            ends = np.cumsum(size)
            gram = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
            keep = np.ones(len(gram), bool)                  # no trigram across two words
            keep[ends[:-1] - 2] = False
            keep[ends[:-1] - 1] = False
            weight = np.repeat(n, size)[:len(gram)]
            u, inv = np.unique(gram[keep], return_inverse=True)
            for g, k in zip(u.tolist(), np.bincount(inv, weight[keep]).tolist()):
                total[g] = total.get(g, 0) + int(k)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["gram", "n"])


def fit_trigrams(docs: DataFrame, text_col="text", letters: int = LETTERS) -> Trigrams:
    """Counted over every text. The driver gets the trigrams of the most
    frequent letters only (at most (LETTERS + 2) ** 3 numbers)."""
    counts = C.materialize(docs.select(text_col).mapInArrow(C.lean(count_trigrams), "gram long, n long")
                           .groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    last = F.expr("gram & 2097151")
    top = [r[0] for r in counts.groupBy(last.alias("c")).agg(F.sum("n").alias("n")).where(F.col("c") != ord("^"))
           .orderBy(F.desc("n"), "c").limit(letters).collect()]
    keep = [*top, ord("^")]

    def known(shift):
        c = F.expr(f"shiftright(gram, {shift}) & 2097151")
        return F.when(c.isin(keep), c).otherwise(F.lit(0x10FFFF)).alias(f"c{shift}")
    rows = counts.select(known(42), known(21), known(0), "n").groupBy("c42", "c21", "c0").agg(F.sum("n")).collect()
    return Trigrams.fit({chr(a) + chr(b) + chr(c): int(n) for a, b, c, n in rows}, letters)


# --- 2. features


def features(word: str) -> tuple[str, ...]:
    """A word, its beginnings and its endings of 3 to 8 letters."""
    n = len(word)
    return (word, *(word[:k] + ">" for k in range(3, min(9, n))), *("<" + word[-k:] for k in range(3, min(9, n))))


def finder(names: list[str]):
    """Function from a word to the places in ``names`` of its features. Only the
    names that share the word's first or last three letters are looked at."""
    at = {f: i for i, f in enumerate(names)}
    front: dict[str, list] = {}
    back: dict[str, list] = {}
    for f, i in at.items():
        if f.endswith(">") and 4 <= len(f) <= 9:
            front.setdefault(f[:3], []).append((f[:-1], len(f) - 1, i))
        if f.startswith("<") and 4 <= len(f) <= 9:
            back.setdefault(f[-3:], []).append((f[1:], len(f) - 1, i))

    def find(w: str) -> tuple[int, ...]:
        found = {at[w]} if w in at else set()
        n = len(w)
        if starts := front.get(w[:3]):
            found.update([i for p, k, i in starts if k < n and w.startswith(p)])
        if ends := back.get(w[-3:]):
            found.update([i for p, k, i in ends if k < n and w.endswith(p)])
        return tuple(found)
    return find


def sample_words(model: Trigrams):
    def run(batches):
        known: dict = {}
        for batch in batches:
            for b in T.slices(batch, 1, SLICE):
                values, pos, rows, extra, extra_rows = doc_words(b.column(1), known, lambda w: (w,), model)
                mine: list[set] = [set() for _ in range(b.num_rows)]
                for p, r in zip(pos.tolist(), rows.tolist()):
                    mine[r].add(values[p])
                for w, r in zip(extra, extra_rows.tolist()):
                    mine[r].add(w)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(s) for s in mine], pa.list_(pa.string()))],
                                                 ["toxic", "words"])
    return run


def choose_features(sample: DataFrame, width: int = FEATURES, min_docs: int = MIN_DOCS) -> list[str]:
    """Features whose frequency differs most between the labels."""
    n1, n0 = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    by_word = sample.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    parts = F.expr("filter(concat(array(w), transform(sequence(3, 8), k -> case when k < length(w) then concat(left(w, k), '>') end), "
                   "transform(sequence(3, 8), k -> case when k < length(w) then concat('<', right(w, k)) end)), x -> x is not null)")
    stat = by_word.withColumn("f", F.explode(parts)).groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    a, b = (F.col("t") + 0.5) / (n1 + 1.0), (F.col("c") + 0.5) / (n0 + 1.0)
    z = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    top = stat.where(F.col("t") + F.col("c") >= min_docs).select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(width)
    return [r[0] for r in top.collect()]


def present(names: list[str]):
    find = finder(names)

    def run(batches):
        for b in batches:
            ids = [sorted({i for w in words for i in find(w)}) for words in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["toxic", "ids"])
    return run


def fit_regression(rows: list[list[int]], y: np.ndarray, width: int, ridge: float = RIDGE, steps: int = 400):
    """Ridge logistic regression on 0/1 features (Nesterov steps)."""
    n = len(y)
    lens = np.array([len(r) for r in rows], np.int64)
    col = np.fromiter((i for r in rows for i in r), np.int64, int(lens.sum()))
    row = np.repeat(np.arange(n), lens)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w = v = np.zeros(width + 1)
    w[width] = math.log(share / (1 - share))
    v = w.copy()
    # diagonal scaling: curvature bound of each coordinate times the longest row
    h = np.append(np.bincount(col, minlength=width), n) * 0.25 * (lens.max(initial=0) + 1) / 4 + ridge
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], minlength=n) + v[width], -30, 30)))
        g = np.append(np.bincount(col, (p - y)[row], minlength=width), (p - y).sum()) + ridge * np.append(v[:width], 0)
        new = v - g / h
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def scorer(model: Trigrams, names: list[str], weights: np.ndarray):
    """Function from a string array to scores."""
    make = finder(names)
    width = max(1, len(names))
    known: dict = {}

    def run(text: pa.Array) -> np.ndarray:
        values, pos, rows, extra, extra_rows = doc_words(text, known, make, model)
        f = np.concatenate([np.array(values, np.int64)[pos] if len(pos) else np.zeros(0, np.int64),
                            np.array(extra, np.int64)])
        pair = np.unique(np.concatenate([rows, extra_rows]).astype(np.int64) * width + f)
        total = np.bincount(pair // width, weights[pair % width], minlength=len(text))
        return 1 / (1 + np.exp(-np.clip(total + weights[-1], -30, 30)))
    return run


def score_texts(model: Trigrams, names: list[str], weights: np.ndarray):
    score = scorer(model, names, weights)

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, 2, SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score(b.column(2)))],
                                                 ["doc_id", "held_out", "score"])
    return run


def keep_clean(model: Trigrams, names: list[str], weights: np.ndarray, column: int):
    """Whole rows whose score is below one half."""
    score = scorer(model, names, weights)

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, column, SLICE):
                yield b.filter(pa.array(score(b.column(column)) < 0.5))
    return run


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """(trigram model, feature names, weights)."""
    model = fit_trigrams(docs)
    lab = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max((F.col("toxic") > 0).cast("long")).alias("toxic"))
           .orderBy(F.xxhash64("__id"), "__id").limit(train_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("body"))
    picked = (texts.join(F.broadcast(C.materialize(lab, "labelled")), "__id").select("toxic", "body"))  # train_rows at most
    words = C.materialize(picked.mapInArrow(C.lean(sample_words(model)), "toxic long, words array<string>"), "sample-words")
    n, pos = words.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or pos in (0, n):
        share = min(max(pos / n, 1e-9), 1 - 1e-9) if n else 1e-9
        return model, [], np.array([math.log(share / (1 - share))])
    names = choose_features(words)
    got = words.mapInArrow(present(names), "toxic long, ids array<int>").collect()                      # train_rows at most
    got.sort(key=lambda r: (r[0], r[1]))
    return model, names, fit_regression([r[1] for r in got], np.array([r[0] for r in got], float), len(names))


def scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model, names, weights = train(docs, labels, train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").alias("body"))
    out = rows.mapInArrow(C.lean(score_texts(model, names, weights)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns."""
    how = keep_clean(*train(docs, labels, train_rows), docs.columns.index("text"))
    return docs.mapInArrow(C.lean(how), docs.schema)


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


QUERIES = {"op2_noisy_channel_toxicity": op2_noisy_channel_toxicity}
ORACLES: dict[str, str] = {}
