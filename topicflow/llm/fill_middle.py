"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`` or a run of
white space at its end): each batch of texts becomes a list array of units,
the lists are flattened with their parents' indices, every unit gets its
ordinal within its text, the units of each role (prefix, middle, suffix) are
filtered by ordinal and rebuilt into lists, and the pieces are joined with the
marks of the text's form. Restoring splits an output at its marks and joins
the pieces in their old order.

Places of the cuts and the form depend on the id alone (four 32-bit groups of
sha256 of ``seed:id``), so reruns and lost executors give the same rows.

Edge cases: null text is empty; empty texts, texts without a chosen form and
texts that contain a mark stay plain (the text itself, no piece lengths); a
null id is hashed as the empty string; very long texts are one unit list in
64-bit offsets; repeated rows are transformed each; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80          # per cent of texts transformed; of these, per cent suffix first
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
CUT = b"\xff"                              # no byte of UTF-8 text, so safe as a separator
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_lists(text: pa.Array) -> pa.Array:
    """List array of each text's units, as bytes."""
    marked = pc.replace_substring_regex(text.cast(pa.large_binary()), UNIT, CUT + rb"\1")
    return pc.split_pattern(marked, CUT)   # the first element of each list is empty


def pieces(units: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of every text, cut after ``first`` and
    ``second`` units."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units).to_numpy()
    start = units.offsets.to_numpy()[:-1] - units.offsets[0].as_py()
    ordinal = np.arange(len(flat)) - start[parent] - 1       # -1: the empty element before the first unit
    lengths = pc.list_value_length(units).to_numpy(zero_copy_only=False) - 1
    out = []
    for low, high in ((np.zeros_like(first), first), (first, second), (second, lengths)):
        role = (ordinal >= low[parent]) & (ordinal < high[parent])
        offsets = np.concatenate([[0], np.cumsum(high - low)])
        mine = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat.filter(pa.array(role)))
        out.append(pc.binary_join(mine.cast(pa.list_(pa.large_binary())), pa.scalar(b"", pa.large_binary()))
                   .cast(pa.large_string()))
    return out


def join(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts],
                                       pa.scalar("", pa.large_string()))


def transform(text: pa.Array, h: np.ndarray, rate: int, spm_rate: int):
    """(n, form, prefix chars, middle chars, output) of a string array; ``h``
    holds four numbers a row."""
    text = text.fill_null("").cast(pa.large_string())
    units = unit_lists(text)
    n = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    n[pc.equal(text, "").to_numpy(zero_copy_only=False)] = 0
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    prefix, middle, suffix = pieces(units, np.minimum(a, b), np.maximum(a, b))
    marked = [pc.match_substring(text, m).to_numpy(zero_copy_only=False) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = pa.array((n == 0) | marked[0] | marked[1] | marked[2] | (h[:, 2] % 100 >= rate))
    spm = pa.array(h[:, 3] % 100 < spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    output = pc.if_else(plain, text, pc.if_else(spm, join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
                                                join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return pa.array(n), form, *chars, output


def halves(text: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``mark`` (all texts hold it)."""
    parts = pc.split_pattern(text, mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def rebuild(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that ``transform`` was given, from outputs and forms alone."""
    output = output.fill_null("").cast(pa.large_string())
    rows, back = [], []
    for kind in ("plain", "spm", "psm"):
        at = pc.indices_nonzero(pc.equal(form, kind))
        mine = output.take(at)
        if kind != "plain":
            head, rest = halves(mine, PREFIX if kind == "spm" else SUFFIX)
            head = pc.utf8_slice_codeunits(head, len(PREFIX))           # without the mark it starts with
            body, middle = halves(rest, MIDDLE)
            prefix, suffix = (body, head) if kind == "spm" else (head, body)
            mine = join(prefix, middle, suffix)
        rows.append(at)
        back.append(mine)
    order = np.argsort(np.concatenate([r.to_numpy() for r in rows]), kind="stable")
    return pa.chunked_array(back, pa.large_string()).take(pa.array(order)).combine_chunks()


def fill_batches(rate: int, spm_rate: int):
    def run(batches):
        for batch in batches:
            for b in T.slices(batch, 1):
                h = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 6)], axis=1)
                cols = transform(b.column(1), h, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([b.column(0), *cols[:-1], cols[-1].cast(pa.string())],
                                                 [x.split()[0] for x in RESULT.split(", ")])
    return run


def restore_batches(batches):
    for batch in batches:
        names = batch.schema.names
        at = names.index("output")
        for b in T.slices(batch, at):
            text = rebuild(b.column(at), b.column(names.index("form"))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*names, "restored"])


def fill_in_middle(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE) -> DataFrame:
    """RESULT rows: one per row of ``docs``, ``output`` is the transformed text."""
    ident = F.col(id_col).cast("long")
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(ident.alias("doc_id"), F.col(text_col).cast("string").alias("body"), *h)
    return rows.mapInArrow(fill_batches(rate, spm_rate), RESULT)


def restore(transformed: DataFrame) -> DataFrame:
    """Adds ``restored``, the exact text before the transformation, from the
    columns ``output`` and ``form``."""
    from pyspark.sql.types import StringType, StructField, StructType
    return transformed.mapInArrow(restore_batches, StructType([*transformed.schema.fields, StructField("restored", StringType())]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = restore(fill_in_middle(C.read(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(cast(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  cast('0x' || substr(s, 1, 8) AS BIGINT) AS h1, cast('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
  cast('0x' || substr(s, 17, 8) AS BIGINT) AS h3, cast('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, cast(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
  greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(x) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN cast(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || m
         ELSE '<P>' || x || '<S>' || z || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": SQL}
