"""Small Column helpers for posts, labels and display (P08-P10, P12, P16,
P17, S08, S09, X22)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import J_EDGE_SPACES, _c

# Fixed value: host prefix of post permalinks.
PERMALINK_HOST = "https://www.reddit.com"


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), J_EDGE_SPACES, "")


def post_text(title, body, include_title: bool = True) -> Column:
    """``(title + "\\n\\n" + body).strip()`` or body-else-title."""
    t = F.coalesce(_c(title), F.lit(""))
    b = F.coalesce(_c(body), F.lit(""))
    if include_title:
        return py_strip(F.concat(t, F.lit("\n\n"), b))
    return F.when(b != "", b).otherwise(t)


def has_text(title, body) -> Column:
    """Title or body has a non-blank character."""
    return (F.length(py_strip(F.coalesce(_c(title), F.lit("")))) > 0) | (
        F.length(py_strip(F.coalesce(_c(body), F.lit("")))) > 0)


def label_rule(subreddit, flair, bucket, mode: str = "hybrid") -> Column:
    """P10: ``subreddit`` mode = bucket else subreddit; ``flair`` and
    ``hybrid`` = stripped flair else bucket else subreddit."""
    sub_or_bucket = F.coalesce(F.when(_c(bucket) != "", _c(bucket)), _c(subreddit))
    if mode == "subreddit":
        return sub_or_bucket
    if mode in ("flair", "hybrid"):
        fl = py_strip(F.coalesce(_c(flair), F.lit("")))
        return F.when(fl != "", fl).otherwise(sub_or_bucket)
    raise ValueError(f"Unknown label mode: {mode}")


def iso_utc(epoch_seconds) -> Column:
    """Epoch seconds -> ``YYYY-MM-DDTHH:MM:SS+00:00`` whatever the session
    time zone; microseconds are appended when non-zero, as Python does."""
    ts = F.timestamp_seconds(_c(epoch_seconds))
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    base = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(wall, "SSSSSS")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros))
                    .otherwise(F.lit("")), F.lit("+00:00"))


def first_category(cats) -> Column:
    """First element of a category list, else ``unknown``."""
    return F.coalesce(F.try_element_at(_c(cats), F.lit(1)), F.lit("unknown"))


def category_root(cats) -> Column:
    """First list item, first blank-separated code, part before ``.``."""
    first = F.try_element_at(_c(cats), F.lit(1))
    code = F.try_element_at(F.split(py_strip(first), r"\s+"), F.lit(1))
    root = F.substring_index(code, ".", 1)
    return F.coalesce(F.when(root != "", root), F.lit("unknown"))


def primary_category(target) -> Column:
    """Prefix before the first ``.``."""
    return F.substring_index(_c(target), ".", 1)


def display_name(model) -> Column:
    """``_`` -> blank, then title case (Python ``str.title``)."""
    return F.initcap(F.regexp_replace(_c(model), "_", " "))


def model_input(text, domain=None, with_domain: bool = False) -> Column:
    """The model sees the text only; the domain-prefixed variant is off
    by default to avoid leakage."""
    if with_domain and domain is not None:
        return F.concat_ws(": ", _c(domain), _c(text))
    return _c(text)


def correct_flag(y, p) -> Column:
    """P15."""
    return _c(y) == _c(p)
