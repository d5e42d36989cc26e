"""DuckDB (RE2) spellings of the cleaning and token rules, used only to write
the value oracle SQL (SURVEY §5.1). Each builder takes a SQL expression and
returns a SQL expression string.
"""
from __future__ import annotations

from .tokens import LEMMAS_EN, PUNCT_KEEP, STOP_WORDS_EN

D_WORD = r"[\p{L}\p{N}_]"
D_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
D_NONSPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
D_URL = rf"https?://{D_NONSPACE}+|www\.{D_NONSPACE}+"
D_EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def light(x: str) -> str:
    y = f"coalesce(CAST({x} AS VARCHAR), '')"
    y = rx(y, "<[^>]+>", " ")
    y = rx(y, D_URL, " [URL] ")
    y = rx(y, D_EMAIL, " [EMAIL] ")
    y = rx(y, rf"#({D_WORD}+)", r"hashtag_\1")
    y = rx(y, rf"@({D_WORD}+)", r"mention_\1")
    y = rx(y, r"\n+", " ")
    return f"trim({rx(y, D_SPACE + '+', ' ')})"


def aggressive(x: str) -> str:
    y = f"lower(coalesce(CAST({x} AS VARCHAR), ''))"
    y = rx(y, "<[^>]+>", " ")
    y = rx(y, D_URL, " ")
    y = rx(y, D_EMAIL, " ")
    y = rx(y, rf"#{D_WORD}+", " ")
    y = rx(y, rf"@{D_WORD}+", " ")
    y = rx(y, r"[^a-z0-9\s\x0b\x1c-\x1f\x85\p{Z}]", " ")
    return f"trim({rx(y, D_SPACE + '+', ' ')})"


def nonempty(x: str) -> str:
    inner = f"coalesce({x}, '')"
    return f"length({rx(inner, D_SPACE + '+', '')}) > 0"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def lemma_case(t: str, lemmas=LEMMAS_EN) -> str:
    if not lemmas:
        return t
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(lemmas.items()))
    return f"(CASE {t} {whens} ELSE {t} END)"


def tfidf_tokens(x: str, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> str:
    sl = str_list(stops)
    toks = f"string_split({aggressive(x)}, ' ')"
    toks = (f"list_filter({toks}, lambda t: t <> '' AND NOT list_contains({sl}, t) "
            r"AND regexp_full_match(t, '\p{L}+'))")
    toks = f"list_transform({toks}, lambda t: {lemma_case('t', lemmas)})"
    return (f"list_filter({toks}, lambda t: length(t) >= 3 "
            "AND NOT (length(t) >= 2 AND regexp_full_match(left(t, 1), '[a-z]') "
            "AND replace(t, left(t, 1), '') = '') "
            "AND NOT regexp_full_match(t, '[0-9]+'))")


def tfidf_text(x: str, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> str:
    return f"array_to_string({tfidf_tokens(x, stops, lemmas)}, ' ')"


def light_lemma(x: str, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> str:
    sl = str_list(stops)
    pl = str_list(PUNCT_KEEP)
    toks = f"regexp_extract_all({light(x)}, {q(r'[\p{L}\p{N}_]+|[.!?,]')})"
    lem = f"lower({lemma_case('lower(t)', lemmas)})"
    one = (f"CASE WHEN list_contains({pl}, t) THEN t "
           rf"WHEN regexp_full_match(t, '\p{{L}}+') AND NOT list_contains({sl}, lower(t)) "
           f"AND length({lem}) >= 2 THEN {lem} ELSE NULL END")
    return f"array_to_string(list_filter(list_transform({toks}, lambda t: {one}), lambda t: t IS NOT NULL), ' ')"


def md5_key(id_expr: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"
