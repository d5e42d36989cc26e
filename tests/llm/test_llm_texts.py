"""Exact dedup, Jaccard join, repeated substrings: against brute force."""
import hashlib
import random
import re

import pytest

from topicflow.llm import exact_dedup, parity_join, prefix_free

CLASH = "doc_id long, text string, n long, body string, key long, cid long, size long, doc long, tie long, row string"


def table(spark, rows):
    """Documents with extra columns that carry the operators' own names."""
    return spark.createDataFrame([(i, t, 7, "x", 1, 2, 3, 4, 5, "y") for i, t in rows], CLASH)


WORDS = [f"w{i}" for i in range(400)]


def words(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(rnd, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rnd.randrange(len(w))] = rnd.choice(WORDS)
    return " ".join(w)


# --- exact dedup


def by_hand(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    rnd = random.Random(1)
    base = [words(rnd, 30) for _ in range(20)]
    rows = [(i, rnd.choice(base).replace(" ", rnd.choice([" ", "\t\n", "  "]), 2)) for i in range(200, 0, -1)]
    rows += [(500, None), (499, ""), (498, " "), (497, "\t"), (None, base[0]), (None, "alone"), (None, "alone"), (7, base[3]), (7, base[3]),
             (600, "é" * 300_000), (601, "é" * 300_000), (602, "é" * 299_999), (603, "a\xa0b"), (604, "a b")]
    got = exact_dedup.exact_groups(table(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)
    assert exact_dedup.exact_groups(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_trie_spills_by_subtree(tmp_path):
    rnd = random.Random(2)
    keys = [(rnd.choice("ab") * rnd.randrange(0, 6) + words(rnd, rnd.randrange(0, 8))).encode() for _ in range(600)]
    trie = exact_dedup.Trie(4000, lambda: exact_dedup.SpillFile(f"file://{tmp_path}"))
    want = {}
    for i, k in enumerate(keys):
        trie.insert(k, i if i % 3 else None, 1)
        low, n = want.get(k, (None, 0))
        want[k] = (exact_dedup.least(low, i if i % 3 else None), n + 1)
    assert trie.spilled
    assert {k: (low, n) for k, low, n in trie.drain()} == want
    assert not list(tmp_path.iterdir())


# --- Jaccard join


def sets_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(s), low.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("small", [32, 3])
def test_jaccard_components(spark, small):
    """Near copies of all sizes, a passage that many texts share, chains; with
    ``small`` = 3 nearly every key counts as a large one."""
    rnd = random.Random(3)
    passage = words(rnd, 60)
    rows, n = [], 0
    for size in (1, 3, 5, 6, 9, 20, 40, 66, 90, 150, 300, 700):
        for _ in range(3):
            t = words(rnd, size)
            for _ in range(4):
                rows.append((n := n + 1, t))
                t = edited(rnd, t, rnd.choice([0.005, 0.02, 0.04]))
    for _ in range(25):
        rows.append((n := n + 1, passage + " " + words(rnd, rnd.choice([6, 15, 40, 90]))))
    hub = words(rnd, 200)
    rows += [((n := n + 1), edited(rnd, hub, 0.01)) for _ in range(20)]
    rows += [(1001, None), (1002, ""), (1003, " \t"), (None, hub), (None, "lone words of a null id here"), (1004, rows[40][1].upper()),
             (1005, rows[40][1]), (1005, rows[40][1])]
    got = parity_join.jaccard_components(table(spark, rows).repartition(4), small=small)
    assert sorted(((None if r.no_id else r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == components(rows)
    assert parity_join.jaccard_components(table(spark, rows).limit(0)).count() == 0


def test_parity_sketches_bound_the_difference():
    import numpy as np
    rnd = np.random.default_rng(4)
    for n in (3, 64, 70, 130, 400, 3000):
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.1], rnd.integers(0, 2**64, n // 10, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert parity_join.hamming(parity_join.bits(a), parity_join.bits(b)) <= differ
        for j, _ in parity_join.schemes(len(a)):
            x, y = set(parity_join.part_keys(a, j).tolist()), set(parity_join.part_keys(b, j).tolist())
            assert len(x - y) <= differ and len(y - x) <= differ
        assert all(len(parity_join.part_keys(a, j)) > most for j, most in parity_join.schemes(len(a)))


def test_sets_with_too_few_parts(spark):
    """The exact way for sets whose hashes fill too few parts, on all sets."""
    rnd = random.Random(8)
    base = words(rnd, 80)
    rows = [(1, base), (2, edited(rnd, base, 0.02)), (3, words(rnd, 80)), (4, words(rnd, 5))]
    d = table(spark, rows).selectExpr("doc_id", "text as body")
    got = {tuple(sorted(r.members)) for r in parity_join.candidate_groups(d, fine=True).where("key is null").collect()}
    assert len(got) == 1 and len(next(iter(got))) == 2


def test_large_keys_are_packed(spark):
    """Rows for the large keys of a group are bounded by buckets and partitions,
    not by its members, and unpacking gives each member's keys."""
    rnd = random.Random(9)
    base = words(rnd, 40)
    rows = [(i, edited(rnd, base, 0.01) + f" tail{i}") for i in range(400)]
    groups = parity_join.candidate_groups(table(spark, rows).selectExpr("text as body"), small=5)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < groups.where("scheme <> -1 and key is not null").count() <= parts * parts
    got = {(r.scheme, r.cid): sorted(r["keys"]) for r in parity_join.large_keys(groups).collect()}
    import numpy as np
    import pyarrow as pa
    sets = {parity_join.class_id(x): x for x in parity_join.shingle_sets(pa.array([t for _, t in rows]))}
    own = {(j, c): (np.uint64(j << parity_join.SHIFT) | (parity_join.part_keys(x, j) >> np.uint64(64 - parity_join.SHIFT))).tolist()
           for c, x in sets.items() for j, _ in parity_join.schemes(len(x))}
    count = {}
    for j, c in own:
        for k in own[j, c]:
            count[k] = count.get(k, 0) + 1
    assert got == {jc: sorted(k for k in ks if count[k] > 5) for jc, ks in own.items() if any(count[k] > 5 for k in ks)}


# --- repeated substrings


def repeats(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0]))
    seen, out = set(), []
    for k in order:
        i, t = rows[k]
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [256, 2])
def test_repeated_substrings(spark, many):
    rnd = random.Random(5)
    passage, line = words(rnd, 40), words(rnd, 22)
    rows = []
    for i in range(60):
        t = words(rnd, rnd.choice([5, 40, 120]))
        rows.append((i, rnd.choice([t, t + " " + passage, passage + " " + t, t + "\n" + line + "\n" + words(rnd, 9), t + t])))
    rows += [(100 + i, edited(rnd, rows[3][1] * 3, 0.03)) for i in range(6)]
    rows += [(200, None), (201, ""), (202, "a" * 5000), (203, "ab" * 900 + "c"), (204, "é" * 700), (205, rows[3][1]), (206, "x" * 99),
             (207, "x" * 100), (208, "x" * 101), (209, "\0" * 150 + "q"), (None, passage + words(rnd, 30))]
    got = prefix_free.remove_repeats(table(spark, rows).repartition(4), many=many)
    have = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    assert sorted(have, key=str) == repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    assert prefix_free.remove_repeats(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("many", [256, 2])
def test_rows_that_repeat_id_and_text_are_one_document(spark, many):
    """Repeated rows lose what an earlier document holds, not what only their
    own copies hold; in one task and in several."""
    rnd = random.Random(7)
    base, line = words(rnd, 150), words(rnd, 30)
    docs = [(1, words(rnd, 120)), (2, line + " " + words(rnd, 60)), (3, base)]
    docs += [(10 + i, edited(rnd, base, 0.03) + "\n" + line + "\n" + words(rnd, 9)) for i in range(8)]
    docs += [(30, "ab" * 300), (None, words(rnd, 90) + " " + line)]
    rows = [r for r in docs for _ in range(3)]
    want = dict(zip([str(d) for d in sorted(docs, key=lambda d: str(d[0]))], sorted(repeats(docs), key=lambda r: str(r[0]))))
    assert want[str(docs[0])][2] == 0 and 0 < want[str(docs[-1])][2] < 300
    for d in (table(spark, rows).coalesce(1), table(spark, rows * 2).repartition(5)):
        got = prefix_free.remove_repeats(d, many=many)
        have = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
        n = len(have) // len(docs)
        assert n in (3, 6) and sorted(have, key=str) == sorted([w for w in want.values() for _ in range(n)], key=str)


@pytest.mark.parametrize("bits", [1, 62])
def test_row_keys_of_null_and_repeated_ids(spark, bits):
    """Different texts under one id, or under none, stay different documents
    even if hashes of a single bit collide."""
    rnd = random.Random(8)
    a, b, c, d, e = (words(rnd, 40) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (7, e), (7, ""), (None, "")]
    got = prefix_free.remove_repeats(table(spark, rows).repartition(3), tie_bits=bits).collect()
    lost = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=str)
    want = [(i, len(t), len(t) if (i, t) == (None, a) else 0) for i, t in rows]
    assert lost == sorted(want, key=str)
    keys = prefix_free.row_keys(table(spark, rows), "doc_id", "text", bits).select("doc", "tie").distinct().count()
    assert keys == len(set(rows))


def test_phrases_parse_every_string_once(monkeypatch):
    """Pieces and phrases cover each 100-byte string of a text exactly once,
    and equal strings get equal triggers, wherever a piece ends."""
    import numpy as np
    monkeypatch.setattr(prefix_free, "PIECE", 700)
    rnd = random.Random(6)
    body = (words(rnd, 200) + words(rnd, 30) * 3).encode()
    at, trigger_of = [], {}
    for doc, start, size, trigger, _, first, buf, _ in prefix_free.parsed([b"", body, b"short"]):
        for s, k, t, f in zip(start.tolist(), size.tolist(), trigger.tolist(), first.tolist()):
            at += range(s, s + k)
            for j in range(k):
                w = bytes(buf[f + j:f + j + 100])
                assert w == body[s + j:s + j + 100]
                assert trigger_of.setdefault(w, t) == t
        assert set(np.unique(doc)) <= {1}
    assert sorted(at) == list(range(len(body) - 99))
