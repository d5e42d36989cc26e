"""Subword vocabulary and encoder.

Learning: distinct words and their counts form a table; a word is a string of
marked pieces, at first its characters (with a continuation mark on all but the
first). A round counts adjacent pairs, merges the most frequent ones that share
no piece with a more frequent one of the round, and replaces them in the words
that hold them. Pair counts are kept from round to round: only words that
changed are taken apart again, and their difference is added.

Encoding: known words look their pieces up; a word that was not seen is merged
in the order the merges were learned. Both are JVM expressions over distinct
words. Texts are encoded row by row: a task merges the different words of a few
texts and lays their pieces out as arrays, so no word travels.

The driver holds the merges and the alphabet (parameters bound both); words
and pairs stay in tables.

Edge cases: null and empty texts have no pieces; characters outside the
alphabet get the id of unknown pieces; ties are merged in alphabetical order;
an empty corpus gives an empty vocabulary.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.tokens import encode_fixed, vectorizer_tokens
from .common import materialize

OPEN, CLOSE = "\x01", "\x02"             # around each piece; texts' tokens hold letters and digits only
MARK = "##"                              # continuation
PAD, UNKNOWN, FIRST = 0, 1, 2
SLICE_ROWS = 64                          # texts encoded at once
MOST_SEEN = 200_000                      # words whose pieces a task keeps


@dataclass(frozen=True)
class Subwords:
    alphabet: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]  # in the order they were learned

    @property
    def pieces(self) -> list[str]:
        return sorted({*self.alphabet, *(joined(a, b) for a, b in self.merges)})

    @property
    def size(self) -> int:
        return len(self.pieces) + FIRST


def joined(a: str, b: str) -> str:
    return a + b.removeprefix(MARK)


def spelled(word) -> Column:
    """A word as marked pieces of one character each."""
    chars = F.split(word, "")
    return F.array_join(F.transform(chars, lambda c, i: F.concat(F.lit(OPEN), F.when(i > 0, F.lit(MARK)).otherwise(F.lit("")), c, F.lit(CLOSE))), "")


def pieces_of(spelling) -> Column:
    """The pieces of a spelling, as an array."""
    return F.filter(F.split(F.translate(spelling, OPEN, ""), CLOSE), lambda p: p != "")


def _pair(a: str, b: str) -> tuple[str, str]:
    return f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}", f"{OPEN}{joined(a, b)}{CLOSE}"


def merged(spelling, merges) -> Column:
    """A spelling after the merges, in their order."""
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in (_pair(a, b) for a, b in merges)])
    return F.aggregate(steps, spelling, lambda s, m: F.replace(s, m["x"], m["y"])) if merges else spelling


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; hot words are added up before they travel."""
    return (docs.select(F.explode(vectorizer_tokens(text_col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def pair_counts(words: DataFrame, weight: str = "n") -> DataFrame:
    """(a, b, n): adjacent pieces, weighted."""
    p = words.select(F.col(weight).alias("w"), pieces_of("s").alias("p")).where(F.size("p") > 1)
    pairs = p.select("w", F.explode(F.transform(F.slice("p", 1, F.size("p") - 1),
                                                lambda x, i: F.struct(x.alias("a"), F.get("p", i + 1).alias("b")))).alias("x"))
    return pairs.groupBy("x.a", "x.b").agg(F.sum("w").alias("n"))


def choose(top: list[tuple[str, str, int]], least: int) -> list[tuple[str, str]]:
    """Of pairs by falling count, those that share no piece with an earlier one."""
    used: set[str] = set()
    out = []
    for a, b, n in top:
        if n < least:
            break
        if a not in used and b not in used:
            out.append((a, b))
        used |= {a, b}
    return out


def learn(counts: DataFrame, merges: int = 2000, per_round: int = 64, least: int = 2, alphabet: int = 1000) -> tuple[Subwords, DataFrame]:
    """(vocabulary, table of (word, n, s) with each word's spelling). The
    alphabet holds the most frequent characters."""
    words = materialize(counts.where(F.length("word") > 0).select("word", "n", spelled("word").alias("s")), "words")
    letters = words.select(F.col("n"), F.explode(pieces_of("s")).alias("c")).groupBy("c").agg(F.sum("n").alias("n"))
    kept = tuple(r["c"] for r in letters.orderBy(F.desc("n"), "c").limit(alphabet).collect())
    pairs = materialize(pair_counts(words), "pairs")
    done: list[tuple[str, str]] = []
    while len(done) < merges:
        top = pairs.orderBy(F.desc("n"), "a", "b").limit(per_round).collect()
        now = choose([(r["a"], r["b"], r["n"]) for r in top], least)[:merges - len(done)]
        if not now:
            break
        new = merged(F.col("s"), now)
        both = materialize(words.select("word", "n", F.col("s").alias("old"), new.alias("s")), "words")
        changed = both.where("s <> old")
        less = changed.select((-F.col("n")).alias("n"), F.col("old").alias("s"))
        delta = pair_counts(less).unionByName(pair_counts(changed.select("n", "s")))
        pairs = materialize(pairs.unionByName(delta).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
        words = both.select("word", "n", "s")
        done += now
    return Subwords(tuple(sorted(kept)), tuple(done)), words


def encode_words(words: DataFrame, model: Subwords, known: DataFrame | None = None) -> DataFrame:
    """(word, pieces) of distinct words: looked up in ``known`` (word, s), else
    merged by rank."""
    if known is None:
        return words.select("word", pieces_of(merged(spelled("word"), model.merges)).alias("pieces"))
    both = words.join(known.select("word", "s"), "word", "left")
    seen = both.where(F.col("s").isNotNull()).select("word", pieces_of("s").alias("pieces"))
    return seen.unionByName(encode_words(both.where(F.col("s").isNull()).select("word"), model))


def piece_ids(spark: SparkSession, model: Subwords) -> DataFrame:
    """(piece, id); bounded by the vocabulary's size."""
    return spark.createDataFrame([(p, i + FIRST) for i, p in enumerate(model.pieces)], "piece string, id int")


def decode(pieces) -> Column:
    """Words of a piece array, joined by blanks."""
    return F.ltrim(F.replace(F.replace(F.concat(F.lit(" "), F.array_join(pieces, " ")), F.lit(" " + MARK), F.lit("")), F.lit("  "), F.lit(" ")))


def _speller(model: Subwords, length: int | None):
    """Task that turns rows of (doc, token lists) into pieces and ids: the
    different words of a slice are merged once each, the rest is array work."""
    names = ["", "", *model.pieces]                           # by id; pieces outside the vocabulary follow
    merges = [_pair(a, b) for a, b in model.merges]

    def spell(word: str, number: dict) -> list[int]:
        s = "".join(f"{OPEN}{MARK if i else ''}{c}{CLOSE}" for i, c in enumerate(word))
        for x, y in merges:
            s = s.replace(x, y)
        return [number.setdefault(p, len(number) + FIRST) for p in s.replace(OPEN, "").split(CLOSE)[:-1]]

    def run(batches):
        number = {p: i + FIRST for i, p in enumerate(model.pieces)}
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                b = batch.slice(k, SLICE_ROWS)
                lists = b.column(1)
                inner = lists.flatten()
                per_list, per_row = np.diff(inner.offsets.to_numpy()), np.diff(lists.offsets.to_numpy())
                list_at = np.concatenate([[0], np.cumsum(per_row)])
                word_at = np.concatenate([[0], np.cumsum(per_list)])
                words = inner.flatten().dictionary_encode()
                spelt = []
                for w in words.dictionary.to_pylist():
                    if w not in seen:
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        seen[w] = spell(w, number)
                    spelt.append(seen[w])
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                known = names + list(number)[len(names) - FIRST:]
                for r in np.flatnonzero(per_row > 1):         # an id's rows take turns, word by word
                    one = [(j, [known[x] for x in spelt[c]], c) for i in range(list_at[r], list_at[r + 1])
                           for j, c in enumerate(code[word_at[i]:word_at[i + 1]].tolist())]
                    code[word_at[list_at[r]]:word_at[list_at[r + 1]]] = [c for _, _, c in sorted(one)]
                size = np.array([len(x) for x in spelt], np.int64)
                first = np.cumsum(size) - size
                table = np.array([x for p in spelt for x in p], np.int64)
                piece_at = np.concatenate([[0], np.cumsum(size[code])])
                pieces = table[np.repeat(first[code] - piece_at[:-1], size[code]) + np.arange(piece_at[-1])]
                row_at = piece_at[word_at[list_at]]
                if length:
                    pieces = pieces[np.arange(len(pieces)) - np.repeat(row_at[:-1], np.diff(row_at)) < length]
                    row_at = np.concatenate([[0], np.cumsum(np.minimum(np.diff(row_at), length))])
                ids = np.where(pieces < len(names), pieces, UNKNOWN).astype(np.int32)
                texts = pa.array(known, pa.string()).take(pa.array(pieces))
                off = pa.array(row_at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, texts), pa.ListArray.from_arrays(off, pa.array(ids))],
                                                 [b.schema.names[0], "pieces", "ids"])
    return run


def encode_texts(docs: DataFrame, model: Subwords, known: DataFrame | None = None, length: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc, pieces, ids) of each text in order, at most ``length`` pieces. A
    word has a piece at least, so only the first ``length`` words are read.
    Each text is encoded in its own row; ``known`` spellings are what the merges
    give, so no word is looked up in another table. Rows of one id become one
    row, their words in turn."""
    def toks(c):
        t = vectorizer_tokens(c)
        return F.slice(t, 1, length) if length else t
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_s")).groupBy(id_col).agg(F.collect_list("_s").alias("_s"))
    lists = texts.select(id_col, F.transform("_s", toks).alias("t"))
    schema = Ty.StructType([lists.schema[id_col], Ty.StructField("pieces", Ty.ArrayType(Ty.StringType())),
                            Ty.StructField("ids", Ty.ArrayType(Ty.IntegerType()))])
    return lists.mapInArrow(_speller(model, length), schema)


def encode_padded(docs: DataFrame, model: Subwords, length: int, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Fixed-length piece ids and attention mask."""
    ids = encode_texts(docs, model, known, length, id_col, text_col)
    input_ids, mask = encode_fixed(F.col("ids"), length, PAD)
    return ids.select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"))
