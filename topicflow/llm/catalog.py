"""Registered queries of the training-data operators and their SQL."""
from __future__ import annotations

from . import (cover_tree, exact_dedup, fill_middle, mixing, packing, parity_join, prefix_free, quality, secrets, token_file,
               toxicity, warc, whitening)

MODULES = (warc, toxicity, exact_dedup, packing, token_file, mixing, parity_join, secrets, cover_tree, prefix_free, fill_middle,
           whitening, quality)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
