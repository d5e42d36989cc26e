"""Toxicity, secrets, embeddings, archives, and the whole pipeline."""
import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from topicflow.llm import cover_tree, secrets, toxicity, warc

CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, base string, cand int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.5, "x", "y", 1) for i, t in rows], CLASH)


# --- toxicity

PLAIN = "the of and idea about water never paper after people other which under stone river green light".split()
BAD = ["idiot", "moron", "worthless"]


@pytest.fixture(scope="module")
def model():
    counts = {}
    for w in PLAIN * 30 + BAD * 10 + ["stupid"] * 10:
        s = f"^^{w}^"
        for i in range(len(s) - 2):
            counts[s[i:i + 3]] = counts.get(s[i:i + 3], 0) + 1
    return toxicity.Trigrams.fit(counts)


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("m0r0n!", "moron"), ("stuuuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"),
                                         ("w0rthl3$$", "worthless"), ("i-d-i-o-t", "idiot"), ("river", "river"), ("river,", "river"),
                                         ("river$$$", "river"), ("m*ron", "moron")])
def test_deobfuscation(model, token, word):
    assert toxicity.restored(token, model) == (word,)


def test_spaced_letters_and_long_tokens(model):
    assert toxicity.viterbi("idiot", model, True).replace(" ", "") == "idiot"
    assert toxicity.restored("", model) == () and toxicity.restored("...", model) == ()
    assert toxicity.restored("a" * 5000, model) in (("a",), ("aa",))
    assert toxicity.viterbi("1" * 4000 + "a", model)


@pytest.mark.parametrize("token, word", [("iiddiioott", "idiot"), ("sttupid", "stupid"), ("moronn,", "moron"), ("green", "green"),
                                         ("worthless", "worthless")])
def test_doubled_letters(model, token, word):
    assert toxicity.restored(token, model) == (word,)


@pytest.mark.parametrize("text, word", [("the s t u p i d, river", "stupid"), ("the 'm o r o n' river", "moron"), ("i d i o t!", "idiot"),
                                        ("an i d i o t ! after", "idiot"), ("s. t. u. p. i. d.", "stupid"), ("river 1 d 1 0 t.", "idiot")])
def test_marks_do_not_end_spaced_words(model, text, word):
    import pyarrow as pa
    _, _, _, extra, rows = toxicity.doc_words(pa.array(["water", None, text]), {}, lambda w: (w,), model)
    assert word in extra and set(rows.tolist()) == {2}


def test_letters_take_the_short_search(model, monkeypatch):
    import random
    rnd = random.Random(3)
    letters = sorted(model.at)
    some = ["".join(rnd.choice(letters) * rnd.choice((1, 1, 1, 2, 3, 5)) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    want = [toxicity.viterbi(t, model) for t in some]
    assert [toxicity.viterbi_letters(t, model) for t in some] == want

    def never(*_):
        raise AssertionError("the whole lattice was searched")
    monkeypatch.setattr(toxicity, "viterbi", never)
    assert [toxicity.restored(t, model) for t in some if toxicity.suspicious(t)] == \
        [(w,) for t, w in zip(some, want) if toxicity.suspicious(t)]


def test_finder_finds_the_features():
    words = ["abcdefghijkl", "abcdef", "abc", "abcd", "ab", "xbcdef", "12<34", "efgh"]
    names = sorted({f for w in words[::2] for f in toxicity.features(w)})
    find = toxicity.finder(names)
    for w in words:
        assert sorted(find(w)) == [i for i, f in enumerate(names) if f in toxicity.features(w)]


def test_toxicity(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(PLAIN) for _ in range(40)]
        bad = rnd.random() < 0.3
        if bad:
            w[rnd.randrange(40)] = rnd.choice(BAD)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    hidden = [(1000, "the 1d10t of the river"), (1001, "about w0rthl3ss water"), (1002, "the m o r o n never"), (1003, "about 5 green lights")]
    rows += hidden + [(2000, None), (2001, ""), (None, "the river"), (2002, "river " * 100_000), (7, rows[7][1])]
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (99_999, 1), (3, labels[3][1])], "doc_id long, toxic int")
    out = toxicity.scores(table(spark, rows), lab).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out)
    assert held and all(r.predicted == labels[r.doc_id][1] for r in held)
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 2000, 2001, 2002)] == [1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    kept = toxicity.clean_documents(table(spark, rows), lab)
    assert kept.columns == table(spark, rows[:1]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if not r.predicted)
    none = toxicity.scores(table(spark, rows[:5]), lab.limit(0)).collect()
    assert len(none) == 5 and all(r.predicted == 0 for r in none)
    assert toxicity.scores(table(spark, rows[:1]).limit(0), lab).count() == 0


# --- secrets


def plain_scan(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rnd = random.Random(2)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(80)]
    rows = [(i, f"some ünï text 😀 {rnd.choice(['token', 'API_KEY', 'Password'])} = \"{h}\" and more words {i}") for i, h in enumerate(hexes[:60])]
    rows += [(100 + i, "mail someone.else@mailserver.example.com or call 4929963689861572 now " + "word" * rnd.randint(4, 9)) for i in range(60)]
    edge = ["", None, "token=", "token=abc", "secret: 'abcdef'", "passwd:x token=abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "f" * 24,
            "to" + "Ken=abcdefg", "x" * 40_000, "deadbeef" * 2000, "a secret=secret=secret1 b", hexes[70].upper() + " bare"]
    rows += [(200 + i, t) for i, t in enumerate(edge)] + [(None, "token=nullid"), (200, ""), (200, "")]
    got = secrets.find_secrets(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, secrets.digest(plain_scan(t or ""))) for i, t in rows), key=str)
    have = []
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        base = [s for s in spans if not s.startswith("cnn")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and r.n_added == len(spans) - len(base)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        have.append((r.doc_id, ",".join(base)))
    assert sorted(have, key=str) == want
    by = {r.doc_id: r for r in got}
    assert all(by[100 + i].n_added == 0 for i in range(60))          # addresses, numbers and words are not secrets
    assert secrets.find_secrets(table(spark, rows).limit(0)).count() == 0


def test_sample_holds_each_window_once(spark):
    hexes = [f"{i:032x}" for i in range(1, 13)]
    texts = [f"a {h} b" for h in hexes for _ in range(20)]
    seen = []
    rows = table(spark, list(enumerate(texts))).select("doc_id", "text").mapInArrow(secrets.scan, secrets.SCAN)
    find = secrets.train
    try:
        secrets.train = lambda found, other: seen.append((found, other))
        secrets.fit(rows, 12)
    finally:
        secrets.train = find
    assert sorted(t for t, _, _ in seen[0][0]) == sorted(f"a {h} b" for h in hexes) and seen[0][1] == []


def test_network_learns_from_every_window(spark, monkeypatch):
    """More windows than a block holds: each is in a block, and each held-out one is counted once."""
    rnd = random.Random(5)
    texts = [f"a token = {rnd.getrandbits(128):032x} b {i}" for i in range(60)]
    texts += ["see " + "".join(rnd.choice(["lo", "rem", "ip", "sum", "dol"]) for _ in range(9)) + f" there {i}" for i in range(240)]
    rows = table(spark, list(enumerate(texts))).select("doc_id", "text").mapInArrow(secrets.scan, secrets.SCAN)
    want = {f: n for f, n in secrets.different(rows).groupBy("found").count().collect()}
    seen, put, settle = [], secrets.C.materialize, secrets.Network.settle
    monkeypatch.setattr(secrets, "LEAST", 10)
    monkeypatch.setattr(secrets.C, "materialize", lambda df, name: (seen.append(put(df, name)), seen[-1])[1])
    monkeypatch.setattr(secrets.Network, "settle", lambda self, counts: (seen.append(counts), settle(self, counts))[1])
    net = secrets.fit(rows, 40)
    held = [r for b in seen[1].collect() for r in b["rows"]]
    assert seen[1].count() == -(-max(want.values()) // 40) > 5
    for f, n in want.items():
        assert len({(r["t"], r["a"], r["b"]) for r in held if r["found"] == f}) == n
    assert sum(seen[2]["found"].values()) == len({r["h"] for r in held if r["found"] and r["aside"]}) > 0
    key = "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(40))
    z = net.logits(*secrets.codes(secrets.windows(f"see {key} there", 4, 44)[:1] + secrets.windows(texts[-1], 4, 20)[:1]))
    assert z[0] > z[1]


def test_runs_covered_in_part_are_candidates(spark):
    hexes = "0123456789abcdef" * 2
    text = f"x KEYZZ{hexes}QWERTYUIOP and {hexes} and mytoken={hexes} and QWERTYUIOPASDFGH"
    got = secrets.candidates(text, secrets.base_spans(text))
    assert [(text[s:e], f) for s, e, f in got if not f] == [(f"KEYZZ{hexes}QWERTYUIOP", None), (f"mytoken={hexes}", None),
                                                            ("QWERTYUIOPASDFGH", False)]
    net = secrets.Network()
    net.threshold = 0.0                                              # every scored candidate is added
    [row] = (table(spark, [(1, text)]).select("doc_id", "text").mapInArrow(secrets.scan, secrets.SCAN)
             .mapInArrow(secrets.decide(net), secrets.RESULT).collect())
    assert f"cnn:{text.index('KEYZZ')}:{text.index(' and')}" in row.spans.split(",") and row.n_added == 3


def test_bare_keys_of_unseen_shapes_in_the_given_texts(spark):
    """Keys of shapes the network was not fitted on, planted without a keyword
    in the given documents: at least 0.9 of each are found, and hardly a span
    is added to texts without one."""
    import pyarrow.parquet as pq
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    found, other = {}, {}
    for t in texts:
        for a, b, f in secrets.candidates(t, secrets.base_spans(t)):
            if f is not None:
                (found if f else other)[secrets.windows(t, a, b)[0]] = 1
    net = secrets.train(sorted(found), sorted(other))
    rnd = random.Random(4)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def many(alphabet, n):
        return "".join(rnd.choice(alphabet) for _ in range(n))
    shapes = {"base62": lambda: many(b62, 33), "prefixed": lambda: "glpat-" + many(b62 + "_", 20), "upper": lambda: many(b62[:26] + "234567", 45),
              "dotted": lambda: many(b62, 12) + "." + many(b62, 22), "url": lambda: many(b62 + "-_", 50)}
    for name, make in shapes.items():
        parts = []
        for _ in range(100):
            around, key = rnd.choice(texts).split()[:4], make()
            before = " ".join(around) + " "
            parts.append(secrets.windows(before + key + " and so on", len(before), len(before) + len(key))[0])
        assert (net.probability(net.logits(*secrets.codes(parts)).astype(float)) >= net.threshold).mean() >= 0.9, name
    clean = [w for w in sorted(other) if not secrets.looks_random(w[0][w[1]:w[2]])]
    added = (net.probability(net.logits(*secrets.codes(clean)).astype(float)) >= net.threshold).sum()
    assert added <= len(texts) / 100


def test_network_finds_bare_secrets():
    rnd = random.Random(3)

    def key():
        return "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(32))

    def word():
        return "".join(rnd.choice(["lo", "rem", "ip", "sum", "dol", "or"]) for _ in range(9))
    found = [w for k in (key() for _ in range(150)) for w in secrets.windows(f"x token = {k} y", 10, 42)[:1]]
    other = [w for k in (word() for _ in range(150)) for w in secrets.windows(f"some {k} text", 5, 5 + len(k))[:1]]
    net = secrets.train(found, other)
    bare = [w for k in (key() for _ in range(40)) for w in secrets.windows(f"look {k} here", 5, 37)[:1]]
    plain = [w for k in (word() for _ in range(40)) for w in secrets.windows(f"look {k} here", 5, 5 + len(k))[:1]]
    score = net.probability(net.logits(*secrets.codes(bare + plain)).astype(float))
    assert (score[:40] >= net.threshold).mean() > 0.8 and (score[40:] >= net.threshold).mean() < 0.1
    assert secrets.train(found[:3], other) is None
    eps, x = 1e-3, secrets.codes(found[:4] + other[:4])             # gradient against differences
    y = np.array([1, 1, 1, 1, 0, 0, 0, 0], np.float32)
    net = secrets.Network()
    g = net.gradient(*x, y)

    def loss():
        z = net.forward(*x)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))
    for name, at in (("out", (3,)), ("conv", (5, 2)), ("bias", (1,)), ("b", (0,))):
        net.p[name][at] += eps
        up = loss()
        net.p[name][at] -= 2 * eps
        down = loss()
        net.p[name][at] += eps
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


# --- embeddings


def test_cover_tree(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([rng.normal(size=(80, 16)), base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 16)) * 0.25,
                        np.repeat(base[:1], 40, axis=0), base[1:2] * np.array([[2.0], [0.5]])]).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, "x", 1), (n + 1, [0.0] * 16, "x", 1), (n + 2, [1.0] * 15 + [float("nan")], "x", 1), (n + 3, [None] + [1.0] * 15, "x", 1),
             (n + 4, [], "x", 1), (n + 5, [1.0, 2.0], "x", 1), (n + 6, [2.0, 4.0], "x", 1), (n + 7, [float("inf")] * 16, "x", 1), (None, x[0].tolist(), "x", 1)]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    f = cover_tree.Forest(n)
    f.link(*np.nonzero(s))
    root = f.roots(np.arange(n))
    low = {r: int(np.flatnonzero(root == r).min()) for r in set(root.tolist())}
    want = {i: (int(s[i].sum()) + int(s[i][0] or i == 0), low[root[i]]) for i in range(n)}
    want |= {n + k: (0, n + k) for k in (0, 1, 2, 3, 4, 7)} | {n + 5: (1, n + 5), n + 6: (1, n + 5), None: (want[0][0], want[0][1])}
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, cid int")
    for block in (4096, 32):
        got = cover_tree.near_duplicates(d, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert cover_tree.near_duplicates(d.limit(0)).count() == 0


# --- archives


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/", "<p>é</p>"), (3, "http://b/\r\nx y", "<p>é</p>"), (9, None, "other"), (1, "u", None), (2, "u", ""), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 50),
            (None, "u", "other"), (None, "v", "null only"), (8, "u", "long" * 400_000), (3, "again", "<p>é</p>"), (11, "u", "z")]
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, key string, first int").repartition(3)
    raw = warc.write(d, f"file://{tmp_path}/raw", archive_bytes=1 << 16)
    for r in raw.collect():                                          # one gzip stream per archive
        data = open(r.uri.removeprefix("file://"), "rb").read()
        z = zlib.decompressobj(31)
        z.decompress(data)
        assert z.eof and not z.unused_data
    members = warc.rewrite(raw, f"file://{tmp_path}/members")
    total = 0
    for r in members.collect():
        data, n = open(r.uri.removeprefix("file://"), "rb").read(), 0
        while data:
            z = zlib.decompressobj(31)
            [rec] = list(warc.records([z.decompress(data)]))
            data, n = z.unused_data, n + 1
        assert n == r.n
        total += n
    assert total == len(rows) + raw.count()                          # and a warcinfo record per archive
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        low = first.get(h or "")
        keep = low is None or i == low
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if keep else "revisit", None if keep else low))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(members).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read(warc.rewrite(warc.write(d.limit(0), f"file://{tmp_path}/e1"), f"file://{tmp_path}/e2")).count() == 0


def test_inflate_reads_any_member_layout():
    recs = [warc.record("response", {"WARC-Record-ID": str(i)}, bytes([i]) * i * 1000) for i in range(20)]
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    mono = one.compress(b"".join(recs)) + one.flush()
    many = b"".join((z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(r) + z.flush() for r in recs)
    import io
    for data in (mono, many):
        assert [raw for _, _, raw in warc.records(warc.inflate(io.BytesIO(data)))] == recs
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(mono[:-20]))))


# --- pipeline


def test_near_copies_of_null_and_repeated_ids(spark):
    import corpus_pipeline as P
    rnd = random.Random(9)

    def group():
        w = [f"w{rnd.randrange(300)}" for _ in range(60)]
        return [" ".join([*w, x]) for x in ("one", "two", "three")]
    a, b, c, d = (group() for _ in range(4))
    docs = table(spark, [(5, a[0]), (None, a[1]), (None, b[0]), (None, b[1]), (None, b[2]), (7, c[0]), (7, d[0]), (6, c[1]), (8, d[1]),
                         (9, "alone here"), (None, "alone there")])
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, None).collect()), key=str)
    low = [t for i, t in got if t in b]
    assert len(low) == 1
    assert got == sorted([(5, a[0]), (None, low[0]), (6, c[1]), (7, d[0]), (9, "alone here"), (None, "alone there")], key=str)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from topicflow.llm import mixing, packing, parity_join
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    stage = dict(P.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    pred = {r.doc_id: r.predicted for r in toxicity.scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    one = P.C.materialize(stage["toxicity"](spark, docs, sf), "t1")
    assert one.columns == docs.columns
    ids = {r.doc_id for r in one.collect()}
    assert ids == {i for i, p in pred.items() if not p}
    two = P.C.materialize(stage["exact dedup"](spark, one, sf), "t2")
    first = {}
    for i in sorted(ids):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    assert sorted(r.doc_id for r in two.collect()) == sorted(first.values()) and two.columns == docs.columns
    three = P.C.materialize(stage["n-gram Jaccard join"](spark, two, sf), "t3")
    comp = parity_join.jaccard_components(two).collect()
    assert sorted(r.doc_id for r in three.collect()) == sorted({r.component_id for r in comp})
    four = P.C.materialize(stage["mixing sources"](spark, three, sf), "t4")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    def multiset(df):
        return sorted(map(tuple, df.collect()), key=repr)
    assert multiset(four) == multiset(mixing.mixed_documents(three))
    taken = {r.doc_id: r.taken for r in mixing.mix(three).collect() if r.taken}
    words = {}
    for r in four.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == taken
    five = stage["best-fit packing"](spark, four, sf).collect()
    assert sorted(map(tuple, five), key=repr) == multiset(packing.pack_documents(four)) == multiset(P.run(spark, sf))
    assert {r.doc_id for r in five} == {r.doc_id for r in four.collect()} and max(r.offset + r.length for r in five) <= packing.CAPACITY
    messy = spark.createDataFrame([(None, None, None, None, None), (1, "a b", "en", None, 3), (1, "a  b", "en", "s", 4), (1, "a b", "en", "s", 3),
                                   (2, "", "en", "s", 0), (3, "c d e f g h", "de", "t", 11)], docs.schema)
    for d, least in ((messy, 1), (messy.limit(0), 0)):
        for name, f in P.STAGES:
            d = P.C.materialize(f(spark, d, sf), "m")
        assert d.count() >= least


def test_pipeline_keeps_columns_and_choices(spark):
    """Clashing column names pass through, and of rows that repeat id and text
    the same one stays however the rows are dealt."""
    import corpus_pipeline as P
    rows = [(1, "a  b", "x", 1, "p"), (1, "a b", "y", 2, "q"), (1, "a b", "x", 3, "r"), (2, "a b", "z", 4, "s"), (None, "c d e f g h", "u", 5, "t"),
            (None, "c d e f g h", "v", 6, "u"), (3, "c d e f g h i j k l m n o p q r", "v", 7, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, sha int, keep_id string")
    stage = dict(P.STAGES)
    kept = [sorted(map(tuple, stage["exact dedup"](spark, d, None).collect()), key=repr) for d in (docs, docs.repartition(5), docs.orderBy("sha"))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3 and kept[0][0][:2] == (1, "a  b")
    near = stage["n-gram Jaccard join"](spark, docs, None)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {1, None, 3}
