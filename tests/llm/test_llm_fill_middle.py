"""Fill-in-middle against a plain per-text version."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from topicflow.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, output string, form string, n long, h1 int, body string, restored string"


def plain_version(text, h, rate=50, spm_rate=80):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def groups(doc_id, seed=42):
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(d[8 * k:8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("rate, spm_rate", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_batches_equal_the_plain_version(rate, spm_rate):
    draw = random.Random(rate + spm_rate)
    texts = ["".join(draw.choice(" \t\n\x0b\x1c abé漢𝄞.<PSM>\x00") for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", " ", "  \n", " a ", "a", "<P>", "<S", "<<M>", "S>x <P", "a" * 5000, "a " * 30000]
    h = np.array([[draw.getrandbits(32) for _ in range(4)] for _ in texts])
    cols = M.transform(pa.array(texts, pa.string()), h, rate, spm_rate)
    got = list(zip(*(c.to_pylist() for c in cols)))
    assert got == [plain_version(t, x, rate, spm_rate) for t, x in zip(texts, h.tolist())]
    assert M.rebuild(cols[-1], cols[1]).to_pylist() == [t or "" for t in texts]


def test_slices_of_arrays():
    texts = pa.array(["x y", "one two three", None, "four five six"]).slice(1, 3)
    h = np.array([[1, 2, 0, 0], [5, 6, 0, 0], [0, 3, 0, 99]])
    cols = M.transform(texts, h, 50, 80)
    assert cols[-1].to_pylist() == ["<S> three<P>one<M> two", "", "<P><S><M>four five six"]
    assert M.rebuild(cols[-1], cols[1]).to_pylist() == ["one two three", "", "four five six"]


def test_rows_with_clashing_columns(spark):
    rows = [(1, "the river and the stone", "o", "f", 3, 1, "b", "r"), (1, "the river and the stone", "o", "f", 3, 1, "b", "r"),
            (None, "under the bridge", None, None, None, None, None, None), (2, None, "", "", 0, 0, "", ""), (3, "", "", "", 0, 0, "", ""),
            (4, "word " * 40000, "", "", 0, 0, "", ""), (5, "a <M> b", "", "", 0, 0, "", "")]
    docs = spark.createDataFrame(rows, CLASH)
    got = M.restore(M.fill_in_middle(docs, rate=100)).collect()
    want = sorted(((r[0], *plain_version(r[1], groups(r[0]), 100), r[1] or "") for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got),
                  key=repr) == want
    assert M.restore(M.fill_in_middle(docs.limit(0))).count() == 0


def test_registered_query_restores_every_text(spark):
    from pyspark.sql import functions as F
    rows = M.op11_fill_in_middle(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    j = rows.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), "doc_id")
    assert j.count() == docs.count() and j.where("sha <> restored_sha256").count() == 0
    assert {r[0] for r in rows.select("form").distinct().collect()} == {"plain", "psm", "spm"}
