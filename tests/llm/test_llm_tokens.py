"""Token files, packing, mixing: exact round trips and brute force."""
import bisect
import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from topicflow.llm import mixing, packing, token_file, tokens

TEXTS = ["", " ", "Hello, World! it's CAN'T we'll", "d'Été. İ ſ K x<|endoftext|>y. <|STARTOFTEXT|> a.b... !?'s é́, z　q.\t", None,
         "Ｗｉｄｅ１２ 12ab.cd'll 'S", "é!! ́a b‍. Ὀδυσσεύς. ΣΑΣ.", "a" * 3000, "x.y. " * 4000, "中文 text 123.\nnew\r\nline\x0bq\x1cr"]
SCHEMA = "doc_id long, text string, source string, length long, start long, shard int, piece int, size long, target double, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5, 6.0, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_word_ids_equal_whole_text_ids(whole):
    ids, off = tokens.encoder(tokens.vocabulary()).encode(pa.array(TEXTS, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [whole(t) for t in TEXTS]


def test_plain_words_share_a_call(whole):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdeéèÄñßZ", k=rnd.randint(1, 12))) for _ in range(5000)] + ["don't", "x1y", "İx", "a\u0301b", "中"]
    e = tokens.Encoder(tokens.vocabulary())

    class Counting:
        def __init__(self, t):
            self.t, self.n = t, 0

        def encode_batch_fast(self, texts, **how):
            self.n += len(texts)
            return self.t.encode_batch_fast(texts, **how)
    e.tokenizer = Counting(e.tokenizer)
    ids, off = e.encode(pa.array([" ".join(words), "a " + words[0]]))
    assert ids[:off[1]].tolist() == whole(" ".join(words)) and ids[off[1]:].tolist() == whole("a " + words[0])
    assert 0 < e.tokenizer.n < 20                            # one encoding each would be about 5,000
    e.forget()
    e.final[:] = False                                       # a vocabulary without word ends: one by one
    assert e.encode(pa.array([" ".join(words)]))[0].tolist() == whole(" ".join(words))


@pytest.mark.parametrize("top", [1, 2, 200, 50_000, 2**32])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 127, 128, 129, 1000):
        x = rng.integers(0, top, n).astype(np.uint32)
        x[::50] = 2**32 - 1
        data = token_file.encode_section(x)
        assert (token_file.decode_section(data) == x).all()
        if n == 1000:
            assert (token_file.decode_section(data, 2, 5) == x[256:640]).all()


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 49408, token_file.SECTION + 5000).astype(np.uint32)
    w = token_file.Writer(f"file://{tmp_path}/a.pfr")
    cuts = np.array([0, 10, 10, 900_000, len(x)])
    w.add(np.array([4, 5, 0, 9]), np.array([False, False, True, False]), x, cuts)
    assert w.close() == (4, len(x))
    r = token_file.Reader(f"file://{tmp_path}/a.pfr")
    assert r.doc_ids[[0, 1, 3]].tolist() == [4, 5, 9] and r.nulls.tolist() == [False, False, True, False] and len(r.sections) == 2
    for a, b in ((0, 1), (5, 5), (1000, 1300), (token_file.SECTION - 3, token_file.SECTION + 7), (len(x) - 1, len(x))):
        assert (r.ids(a, b) == x[a:b]).all()
    assert all((ids == x[cuts[i]:cuts[i + 1]]).all() for i, ids in r.documents())


def docs_of(rnd):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "null id", "s"), (3, "again 3", "s"), (3, "again 3", "s")]
    rnd.shuffle(rows)
    return rows


def test_token_files(spark, tmp_path, whole):
    rows = docs_of(random.Random(1))
    got = token_file.read_token_files(token_file.write_token_files(table(spark, rows).repartition(3), f"file://{tmp_path}/t")).collect()
    have = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert [r[1] for r in have] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    assert [r[0] for r in have] == np.cumsum([0] + [r[2] for r in have])[:-1].tolist()
    want = sorted(((i, len(x := whole(t) + [2]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in rows), key=str)
    assert sorted(((r[1], r[2], r[3]) for r in have), key=str) == want
    empty = table(spark, rows).limit(0)
    assert token_file.read_token_files(token_file.write_token_files(empty, f"file://{tmp_path}/e")).count() == 0


def plain_best_fit(lengths, cap):
    room, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, x)
        c = room.pop(i) if i < len(room) else cap
        bins += c == cap
        if c > x:
            bisect.insort(room, c - x)
    return bins, sorted(room)


@pytest.mark.parametrize("cap", [7, 64, 4096])
def test_best_fit_equals_one_by_one(cap):
    rng = np.random.default_rng(cap)
    for n in (0, 1, 5, 300, 3000):
        lengths = np.minimum(cap, 1 + (rng.random(n) ** 3 * cap).astype(int))
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        fill = {}
        for length, rank, first, bins, each, offset in packing.best_fit_decreasing(counts, cap).tolist():
            for b in range(first, first + bins):
                assert fill.get(b, 0) == offset
                fill[b] = offset + each * length
        count, room = plain_best_fit(lengths.tolist(), cap)
        assert len(fill) == count and sorted(cap - f for f in fill.values() if f < cap) == room
        assert sum(fill.values()) == lengths.sum()


def test_pack_documents(spark, whole):
    rows = docs_of(random.Random(2))
    got = packing.pack_documents(table(spark, rows).repartition(3)).collect()
    want = []
    for i, t, _ in rows:
        x = np.array(whole(t) + [1], "<u4")
        want += [(i, k // 4096, k, len(p := x[k:k + 4096]), zlib.crc32(p.tobytes())) for k in range(0, len(x), 4096)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    seqs = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == seqs.get(r.sequence_id, 0)
        seqs[r.sequence_id] = r.offset + r.length
    assert max(seqs.values()) <= 4096 and len(seqs) == plain_best_fit([w[3] for w in want], 4096)[0]
    assert packing.pack_documents(table(spark, rows).limit(0)).count() == 0


# --- mixing


def test_targets_by_hand():
    assert mixing.targets([10, 10, 10]) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert mixing.targets([1000, 1, 1]) == [pytest.approx(1499.0), 2.0, 2.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    t = mixing.targets([5, 50, 500, 3])
    assert sum(t) == pytest.approx(1.5 * 558) and all(x <= 2 * s + 1e-9 for x, s in zip(t, [5, 50, 500, 3]))


def test_sainte_lague_equals_highest_quotients():
    rnd = random.Random(5)
    for _ in range(200):
        votes = [rnd.choice([0, rnd.random() * 100, 1]) for _ in range(rnd.randint(1, 9))]
        seats = rnd.randint(0, 60)
        cap = [rnd.randint(0, 20) for _ in votes]
        got = [0] * len(votes)
        heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and cap[i] > 0]
        heapq.heapify(heap)
        for _ in range(seats):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < cap[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
        assert mixing.sainte_lague(votes, seats, cap) == got


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.choice([0, 3, 40, 300]))), rnd.choice(["a", "a", "a", "b", "c", None]))
            for i in range(300)] + [(None, "one two", "b"), (None, None, "b"), (5, "x y z", "c"), (5, "x y z", "c"), (900, "q " * 20_000, "b")]
    d = table(spark, rows).repartition(4)
    how = dict(shard_words=3000)
    got = mixing.mix(d, **how).collect()
    again = mixing.mix(d.repartition(2), **how).collect()
    key = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got]
    assert sorted(key, key=str) == sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in again), key=str)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, len((t or "").split())) for i, t, _ in rows), key=str)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    taken = {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for s in order:
        assert abs(taken[sizes[s]] - want[s]) <= 2 * mixing.BLOCK_WORDS + 0.01 * want[s]
    texts = mixing.mixed_documents(d, **how)
    assert texts.columns == d.columns
    out = texts.collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in got)
    whole = {(i, t) for i, t, _ in rows}
    assert all((r.doc_id, r.text) in whole or any(r.text in t for i, t in whole if i == r.doc_id and t) for r in out)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixed_documents(d.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(table(spark, [(1, None, "a"), (2, " ", "b")])).collect()} == {0}


def test_rows_of_no_id_spread_over_shards(spark):
    """A third of the rows without an id, and one id repeated with other texts:
    no shard grows with them, and reruns agree."""
    from pyspark.sql import functions as F
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " + "word " * 20, "s") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sized = mixing.sized(docs).persist()
    cuts, quotas = mixing.plan(sized, shard_words=1000)
    sizes = [r.n for r in mixing.deal(sized, cuts).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) > 15 and max(sizes) < 3 * sum(sizes) / len(sizes)
    a, b = (sorted(map(tuple, mixing.mix(d, shard_words=1000).collect()), key=str) for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == 1200
