"""Token ids of whole texts with a public vocabulary, Arrow batch by batch.

The tokenizers library encodes every distinct word once per worker, plain
words many to a call (an encoding each costs more than its word, in time and
in memory); a text's ids are gathered from its words' ids. That equals encoding the whole text,
because this vocabulary's rules (NFC, lower case, a split into letter runs,
digits and runs of other characters, a word-end mark) never look across ASCII
white space, nor across the border of a letter run and a final run of ASCII
punctuation. Texts that hold the mark of a special token are encoded whole.
"""
from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

SLICE_BYTES = 8 << 20        # text handled at once
CACHE_WORDS = 500_000      # distinct words a worker remembers; forgotten together beyond that
TOGETHER = 64 << 10          # bytes of new words encoded in one call
# Latin-1 letters: one piece of the vocabulary's split each, whatever the case.
LETTERS_ONLY = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
WORD_END = "</w>"
FINAL_MARKS = r"(\pL)([!-&(-/:-@\[-`{-~]+)(\s)"

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs one task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values(), default=0) + 1, bool)     # ids that end a word
        self.final[[i for w, i in vocab.items() if w.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int32)
        self.count = np.zeros(1 << 12, np.int32)

    def _apart(self, words: list[str]):
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens

    def _joined(self, words: list[str]):
        """The same for words of letters only, as one text: a word's last id is
        the only one that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        end = np.flatnonzero(self.final[ids])
        if len(end) != len(words) or end[-1] != len(ids) - 1:              # another kind of vocabulary
            return self._apart(words)
        return ids, np.diff(end, prepend=-1)

    def _learn(self, words: pa.Array) -> None:
        letters = pc.match_substring_regex(words, LETTERS_ONLY)
        for some, encode in ((words.filter(letters), self._joined), (words.filter(pc.invert(letters)), self._apart)):
            part = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False) + 1) // TOGETHER
            edges = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *edges], [*edges, len(some)]):
                if b > a:
                    names = some.slice(int(a), int(b - a)).to_pylist()
                    self._keep(names, *encode(names))

    def _keep(self, words: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.count[n:n + m] = lens
        self.start[n:n + m] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + m)))

    def _plain(self, text: pa.Array):
        """Ids and counts of texts without special marks."""
        text = pc.replace_substring_regex(pc.ascii_lower(text), FINAL_MARKS, r"\1 \2\3")
        words = pc.ascii_split_whitespace(text)
        coded = words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py()) \
            .dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            at[new] = np.fromiter((self.known[names[i]] for i in new.tolist()), np.int32, len(new))
        del text, names                                      # the ids take as much again
        at = at[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else at
        lens = self.count[at]
        end = np.cumsum(lens, dtype=np.int64)
        place = np.repeat(self.start[at] - (end - lens), lens)
        place += np.arange(len(place))
        cut = words.offsets.to_numpy(zero_copy_only=False) - words.offsets[0].as_py()
        return self.flat[place], np.diff(np.concatenate([[0], end])[cut])

    def encode(self, text: pa.Array):
        """(ids uint32, offsets int64) of a string array; null is empty."""
        text = text.fill_null("")
        special = np.asarray(pc.match_substring(text, "<|").to_numpy(zero_copy_only=False), bool)
        if not special.any():
            ids, n = self._plain(text)
            return ids, np.concatenate([[0], np.cumsum(n)])
        n = np.zeros(len(text), np.int64)
        ids, n[~special] = self._plain(text.filter(pa.array(~special)))
        whole = [np.array(e.ids, np.uint32) for e in
                 self.tokenizer.encode_batch(text.filter(pa.array(special)).to_pylist(), add_special_tokens=False)]
        n[special] = [len(w) for w in whole]
        off = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(off[-1], np.uint32)
        mark = np.repeat(special, n)
        out[~mark] = ids
        out[mark] = np.concatenate(whole) if whole else []
        return out, off


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES):
    """Parts of a batch with about ``most`` bytes of text (one row at least)."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def encode_with_end(path: str, text: pa.Array, end_id: int):
    """(ids, offsets) with ``end_id`` after every text."""
    ids, off = encoder(path).encode(text)
    ends = off + np.arange(len(off))
    out = np.empty(ends[-1], np.uint32)
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    out[keep] = ids
    out[~keep] = end_id
    return out, ends


def vocabulary() -> str:
    return C.tokenizer_path(C.WORD_PATH)
