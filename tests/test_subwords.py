"""Subword learner and encoder against a naive version."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicflow.operators import subwords as S


def naive(counts: dict, merges: int, per_round: int, least: int = 2):
    """The same rounds, all pairs counted anew each time."""
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in counts}
    done = []
    while len(done) < merges:
        pairs = Counter()
        for w, p in words.items():
            for a, b in zip(p, p[1:]):
                pairs[a, b] += counts[w]
        top = sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:per_round]
        used, now = set(), []
        for (a, b), n in top:
            if n < least:
                break
            if a not in used and b not in used:
                now.append((a, b))
            used |= {a, b}
        now = now[:merges - len(done)]
        if not now:
            break
        for a, b in now:
            for w, p in words.items():
                words[w] = apply(p, a, b)
        done += now
    return done, words


def apply(p, a, b):
    out, i = [], 0
    while i < len(p):
        if i + 1 < len(p) and (p[i], p[i + 1]) == (a, b):
            out.append(S.joined(a, b))
            i += 2
        else:
            out.append(p[i])
            i += 1
    return out


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


COUNTS = {**{w: n for n, w in enumerate("lower lowest newer wider newest aaaa aaa banana bandana ananas été été 漢字漢字 x 1234 12 23".split(), 2)}}


@pytest.mark.parametrize("merges, per_round", [(6, 1), (40, 6)])
def test_merges_equal_the_naive_learner(spark, merges, per_round):
    draw = random.Random(merges)
    counts = dict(COUNTS)
    for _ in range(60):
        counts["".join(draw.choices("abcde", k=draw.randint(1, 7)))] = draw.randint(1, 30)
    model, words = S.learn(table(spark, counts), merges, per_round)
    done, pieces = naive(counts, merges, per_round)
    assert list(model.merges) == done and len(done) > merges // 2
    got = {r.word: r.p for r in words.select("word", S.pieces_of("s").alias("p")).collect()}
    assert got == pieces


def test_unseen_words_are_merged_by_rank_and_decode_back(spark):
    model, words = S.learn(table(spark, COUNTS), 30, 5)
    new = spark.createDataFrame([(w,) for w in ("newlower", "bananananas", "zzz", "a", *COUNTS)], "word string")
    for known in (None, words):
        got = {r.word: r.pieces for r in S.encode_words(new, model, known).collect()}
        for w, p in got.items():
            want = [c if i == 0 else "##" + c for i, c in enumerate(w)]
            for a, b in model.merges:
                want = apply(want, a, b)
            assert p == want
    out = S.encode_words(new, model).select("word", S.decode(F.col("pieces")).alias("back")).collect()
    assert all(r.word == r.back for r in out)


def test_texts(spark):
    docs = spark.createDataFrame([(1, "Lower, NEWEST banana! zq"), (2, None), (3, ""), (4, "newer " * 50), (5, "lower lower")],
                                 "doc_id long, text string")
    model, words = S.learn(S.word_counts(docs), 20, 4, least=1)
    full = {r.doc_id: r for r in S.encode_texts(docs, model, words).withColumn("back", S.decode(F.col("pieces"))).collect()}
    assert full[1].back == "lower newest banana zq" and full[2].pieces == [] and full[3].ids == [] and full[4].back == ("newer " * 50).strip()
    assert set(full[1].ids) <= set(range(S.FIRST, model.size)) and len(full[1].ids) == len(full[1].pieces)
    cut = {r.doc_id: r for r in S.encode_padded(docs, model, 6, words).collect()}
    assert all(len(r.input_ids) == len(r.attention_mask) == 6 for r in cut.values())
    assert cut[4].input_ids == full[4].ids[:6] and cut[2].input_ids == [0] * 6 and sum(cut[1].attention_mask) == min(6, len(full[1].ids))
    other = S.Subwords(("l", "##o"), ())
    assert set(S.encode_texts(docs.where("doc_id = 5"), other).first().ids) == {S.UNKNOWN, 2, 3}
    empty, _ = S.learn(S.word_counts(docs.where("doc_id = 2")), 5)
    assert empty == S.Subwords((), ())


def test_texts_are_encoded_in_their_rows(spark):
    """No row per word, no join: pieces as the naive version gives them, also
    over slices, for unknown characters, null ids and rows of one id."""
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdeé漢", k=draw.randint(1, 9))) for _ in range(draw.randint(0, 40))) for _ in range(3 * S.SLICE_ROWS)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "abc de"), (7000, "abc abd"), (7000, "de bcd cab"), (7000, None)],
                                 "doc_id long, text string").repartition(2)
    model, words = S.learn(S.word_counts(docs), 30, 5, alphabet=6)

    def spelt(text):
        out = []
        for w in text.split():
            p = [c if i == 0 else "##" + c for i, c in enumerate(w)] if len(w) > 1 else []
            for a, b in model.merges:
                p = apply(p, a, b)
            out += p
        return out
    number = {p: i + S.FIRST for i, p in enumerate(model.pieces)}
    for length in (None, 5):
        coded = S.encode_texts(docs, model, words, length)
        assert "Join" not in (plan := coded._jdf.queryExecution().optimizedPlan().toString()) and "Generate" not in plan
        got = {r.doc_id: r for r in coded.collect()}
        assert len(got) == len(texts) + 2
        for i, text in [*enumerate(texts), (None, "abc de"), (7000, "abc de abd bcd cab")]:
            assert got[i].pieces == spelt(text)[:length] and got[i].ids == [number.get(p, S.UNKNOWN) for p in got[i].pieces]
    assert any(S.UNKNOWN in r.ids for r in got.values())
