"""Text cleaning as Spark Column expressions.

Everything here is a composition of built-in ``regexp_replace`` / ``lower`` /
``trim``: it stays in the JVM, no Python worker. Array lambdas (S07, and the
token functions) are interpreted there, not code-generated.

Python's ``re`` is Unicode-aware by default; Java regex is not. The Java
spellings below are chosen so Spark gives the same answer as Python ``re``
(SURVEY §5.1): ``\\w`` becomes ``[\\p{L}\\p{N}_]`` and ``\\s`` becomes
``(?U)[\\s\\x1c-\\x1f]``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The reference's cleaning patterns, in Python ``re`` notation.
# They define the semantics; the Java spellings below must agree with them.
#   URL      https?://\S+|www\.\S+
#   EMAIL    [\w\.-]+@[\w\.-]+\.\w+
#   HTML     <[^>]+>
#   HASHTAG  #\w+
#   MENTION  @\w+
#   REPEAT   ^([a-z])\1+$
# Light placeholders: " [URL] ", " [EMAIL] ", prefixes "hashtag_", "mention_".
# ---------------------------------------------------------------------------
# Java (Spark) spellings of the Python classes.
J_WORD = r"[\p{L}\p{N}_]"
J_SPACE = r"[\s\x1c-\x1f]"          # used under (?U)
J_NONSPACE = r"[^\s\x1c-\x1f]"      # used under (?U)

J_URL = rf"(?U)https?://{J_NONSPACE}+|www\.{J_NONSPACE}+"
# The local part starts where a run of its characters starts, or where the last
# match ended: the only places a leftmost match can start, so a long run
# without "@" is read once instead of once per character.
J_EMAIL = r"(?:\G|(?<![\p{L}\p{N}_.-]))[\p{L}\p{N}_.-]++@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
J_HTML = r"<[^>]+>"
J_HASHTAG = rf"#({J_WORD}+)"
J_MENTION = rf"@({J_WORD}+)"
J_NOT_ALNUM = r"(?U)[^a-z0-9\s\x1c-\x1f]"
# A single blank stays as it is, so only runs that differ from one are matched.
J_SPACES = rf"(?U)(?! {J_NONSPACE}){J_SPACE}+"
J_GAPS = r"[^a-z0-9]+"                              # X09 and X10 in one
J_REPEAT = r"^([a-z])\1+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c, fn) -> Column:
    """``fn`` of a Column that is computed once: inside the lambda it is a bound
    variable, where a plain Python variable would be inlined at every use."""
    return F.get(F.transform(F.array(_c(c)), fn), F.lit(0))


def null_to_empty(c) -> Column:
    """Non-string (null) text becomes the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def lower(c) -> Column:                       # X01
    return F.lower(_c(c))


def strip_html(c) -> Column:                  # X02
    """Only the part up to the last ``>`` can hold a tag; what follows is not
    searched, so unclosed ``<`` cost nothing."""
    def tags(x):
        tail = F.substring_index(x, ">", -1)
        head = F.substring(x, F.lit(1), F.length(x) - F.length(tail))
        return F.concat(F.regexp_replace(head, J_HTML, " "), tail)
    return let(c, tags)


def _having(c, marks, fn) -> Column:
    """``fn`` of the texts that hold one of ``marks``; a pattern cannot match
    the others, and a plain search is much cheaper than a regex."""
    def held(x):
        found = F.contains(x, F.lit(marks[0]))
        for m in marks[1:]:
            found = found | F.contains(x, F.lit(m))
        return F.when(found, fn(x)).otherwise(x)
    return let(c, held)


URL_MARKS = ("http", "www.")


def drop_urls(c) -> Column:                   # X03
    return _having(c, URL_MARKS, lambda x: F.regexp_replace(x, J_URL, " "))


def mark_urls(c) -> Column:                   # X04
    return _having(c, URL_MARKS, lambda x: F.regexp_replace(x, J_URL, " [URL] "))


def drop_emails(c) -> Column:                 # X05
    return _having(c, "@", lambda x: F.regexp_replace(x, J_EMAIL, " "))


def mark_emails(c) -> Column:                 # X06
    return _having(c, "@", lambda x: F.regexp_replace(x, J_EMAIL, " [EMAIL] "))


def drop_tags(c) -> Column:                   # X07
    return _having(c, "#@", lambda x: F.regexp_replace(F.regexp_replace(x, J_HASHTAG, " "), J_MENTION, " "))


def mark_tags(c) -> Column:                   # X08
    return _having(c, "#@", lambda x: F.regexp_replace(
        F.regexp_replace(x, J_HASHTAG, "hashtag_$1"), J_MENTION, "mention_$1"))


def keep_alnum(c) -> Column:                  # X09
    return F.regexp_replace(_c(c), J_NOT_ALNUM, " ")


def squash_spaces(c) -> Column:               # X10
    """Newlines are spaces too, so the light version's earlier pass over them
    is part of this one."""
    # after the collapse the only possible edge character is a plain blank
    return F.trim(F.regexp_replace(_c(c), J_SPACES, " "))


def alnum_words(c) -> Column:                 # X09 + X10
    """``squash_spaces(keep_alnum(c))`` in one pass: what is no ``[a-z0-9]``
    ends as a blank, and runs of those as one."""
    return F.trim(F.regexp_replace(_c(c), J_GAPS, " "))


def lowered_plain(c) -> Column:
    """X11 before its last step: lower, html, url, e-mail, hashtag, mention."""
    x = lower(null_to_empty(c))
    x = strip_html(x)
    x = drop_urls(x)
    x = drop_emails(x)
    return drop_tags(x)


def clean_aggressive(c) -> Column:
    """X11: lower, html, url, e-mail, hashtag, mention, non-alnum, spaces."""
    return alnum_words(lowered_plain(c))


def clean_light(c) -> Column:
    """Html, url/e-mail placeholders, tag prefixes, spaces; case kept."""
    x = null_to_empty(c)
    x = strip_html(x)
    x = mark_urls(x)
    x = mark_emails(x)
    x = mark_tags(x)
    return squash_spaces(x)


def is_nonempty(c) -> Column:
    """``len(x.strip()) > 0`` (Python strip removes Unicode spaces)."""
    return null_to_empty(c).rlike(rf"(?U){J_NONSPACE}")


def preview(c, n: int = 200) -> Column:       # P14
    return F.substring(_c(c), 1, n)


# ---------------------------------------------------------------------------
# S07 newsgroup body extraction (public documented behaviour of the
# "remove headers/footers/quotes" option of the 20-newsgroups loader).
# Quote markers.
#   a line containing "writes in" / "writes:" / "wrote:" / "says:" / "said:"
#   a line starting with "In article" or "Quoted from", "|" or ">"
# ---------------------------------------------------------------------------
J_QUOTE_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"


def strip_header(c) -> Column:
    """Text after the first blank line; empty when there is none."""
    def after(x):
        pos = F.instr(x, "\n\n")
        return F.when(pos > 0, F.substring(x, pos + 2, F.length(x))).otherwise(F.lit(""))
    return let(c, after)


def strip_quotes(c) -> Column:
    """Drop quoted lines, keep the rest joined by newlines."""
    lines = F.split(_c(c), "\n", -1)
    kept = F.filter(lines, lambda ln: ~ln.rlike(J_QUOTE_LINE))
    return F.array_join(kept, "\n")


J_EDGE_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
J_SEPARATOR = r"(?U)^[\s\x1c-\x1f]*-*[\s\x1c-\x1f]*$"


def strip_footer(c) -> Column:
    """Cut before the last separator line (blank or dashes) when it is not
    the first line; otherwise keep the text unchanged."""
    def cut(x):
        lines = F.split(F.regexp_replace(x["text"], J_EDGE_SPACES, ""), "\n", -1)
        return let(F.struct(x["text"].alias("text"), lines.alias("lines")), last_line)

    def last_line(x):
        last = F.array_max(F.transform(x["lines"], lambda ln, i: F.when(ln.rlike(J_SEPARATOR), i)))
        return F.when(last > 0, F.array_join(F.slice(x["lines"], 1, last), "\n")).otherwise(x["text"])

    return let(F.struct(_c(c).alias("text")), cut)


def newsgroup_body(c) -> Column:
    """Headers, then footers, then quotes, as the public loader does."""
    return strip_quotes(strip_footer(strip_header(c)))
