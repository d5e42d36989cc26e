"""Token-level Column expressions.

Token lists are ``array<string>`` columns transformed with higher-order
functions (``filter`` / ``transform``): interpreted in the JVM, no UDF.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import J_REPEAT, _c, clean_light, let, lowered_plain

# ---------------------------------------------------------------------------
# Default English stop list (the public default list shipped
# with Spark's StopWordsRemover, 181 words). The reference uses spaCy's list,
# which is not available here; the list is a parameter everywhere.
# ---------------------------------------------------------------------------
STOP_WORDS_EN = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split())

# ---------------------------------------------------------------------------
# Our own small English lemma dictionary (form -> lemma) for
# irregular forms. The reference uses a statistical lemmatiser; ours is a
# dictionary with identity fallback (declared deviation, SURVEY X16).
# ---------------------------------------------------------------------------
LEMMAS_EN = {
    "children": "child", "men": "man", "women": "woman", "people": "person",
    "mice": "mouse", "feet": "foot", "teeth": "tooth", "geese": "goose",
    "went": "go", "gone": "go", "goes": "go", "going": "go",
    "ran": "run", "running": "run", "runs": "run",
    "saw": "see", "seen": "see", "sees": "see",
    "took": "take", "taken": "take", "takes": "take",
    "made": "make", "makes": "make", "making": "make",
    "said": "say", "says": "say", "told": "tell",
    "got": "get", "gotten": "get", "gets": "get",
    "came": "come", "comes": "come", "knew": "know", "known": "know",
    "thought": "think", "found": "find", "gave": "give", "given": "give",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad",
    "studies": "study", "studied": "study", "data": "datum",
    "analyses": "analysis", "theses": "thesis", "criteria": "criterion",
    "phenomena": "phenomenon", "models": "model", "topics": "topic",
    "games": "game", "movies": "movie", "markets": "market",
}

PUNCT_KEEP = (".", "!", "?", ",")
J_ALPHA = r"^\p{L}+$"
# Words of the light version that are letters throughout, and marks; the other words are dropped anyway.
J_LETTERS_OR_MARK = r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])|[.!?,]"
J_LETTERS = r"(?<![a-z0-9])[a-z]++(?![0-9])"      # the same for a text after X11
J_VECTORIZER_TOKEN = r"[\p{L}\p{N}_]{2,}"   # sklearn (?u)\b\w\w+\b


def _lemma_of(t: Column, lemmas: dict[str, str] | None) -> Column:
    """Dictionary lemma with identity fallback.

    The dictionary travels inside the plan as a map literal, so it must be
    small (it is bounded by the parameter we ship); large dictionaries go
    through :func:`topicflow.operators.features.lemmatize_tokens`.
    """
    if not lemmas:
        return t
    m = F.create_map(*[F.lit(x) for kv in sorted(lemmas.items()) for x in kv])
    # a map is searched entry by entry, a long IN list by hash: only its hits pay for the search
    return F.when(t.isin(sorted(lemmas)), F.coalesce(F.try_element_at(m, t), t)).otherwise(t)


def split_words(c) -> Column:
    """X13 after X11: only ``[a-z0-9 ]`` is left, so split on blanks."""
    return F.filter(F.split(_c(c), " "), lambda t: t != "")


def drop_stop(tokens: Column, stops=STOP_WORDS_EN) -> Column:
    """Keeps duplicates and order (``array_except`` would de-duplicate)."""
    s = list(stops)
    return F.filter(tokens, lambda t: ~t.isin(s))


def keep_alpha(tokens: Column) -> Column:       # X15
    return F.filter(tokens, lambda t: t.rlike(J_ALPHA))


def filter_tokens(tokens: Column) -> Column:
    """Length >= 3, not one repeated letter, not all digits. The regexes
    run on tokens that begin like a match only."""
    def fine(t):
        repeated = (F.substring(t, 1, 1) == F.substring(t, 2, 1)) & t.rlike(J_REPEAT)
        digits = (t < ":") & t.rlike(r"^[0-9]+$")            # ":" follows "9"
        return (F.length(t) >= 3) & ~repeated & ~digits
    return F.filter(tokens, fine)


def tfidf_token_array(text, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> Column:
    """X18 as tokens: X11 -> X13/X15 -> X14 on the form -> X16 -> X17. X11's
    last step leaves the runs of ``[a-z0-9]`` as they are, and only those decide
    what is taken, so it is left out."""
    toks = F.regexp_extract_all(lowered_plain(text), F.lit(J_LETTERS), 0)
    toks = drop_stop(toks, stops)
    toks = F.transform(toks, lambda t: _lemma_of(t, lemmas))
    return filter_tokens(toks)


def tfidf_text(text, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> Column:
    """The TF-IDF text version, tokens joined by one blank."""
    return F.array_join(tfidf_token_array(text, stops, lemmas), " ")


def light_lemmas(light, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> Column:
    """X19 of a text after X12: alphabetic non-stop tokens as lowercase lemmas
    of length >= 2, and the punctuation marks . ! ? , kept as tokens."""
    toks = F.transform(F.regexp_extract_all(_c(light), F.lit(J_LETTERS_OR_MARK), 0), lambda t: F.lower(t))
    toks = drop_stop(toks, [w for w in stops if w not in PUNCT_KEEP])
    # the dictionary neither changes marks nor makes them
    words = {f: "" if m in PUNCT_KEEP else m for f, m in (lemmas or {}).items() if f not in PUNCT_KEEP}
    toks = F.transform(toks, lambda t: F.lower(_lemma_of(t, words)))
    return F.array_join(F.filter(toks, lambda t: (F.length(t) >= 2) | t.isin(*PUNCT_KEEP)), " ")


def light_lemma_text(text, stops=STOP_WORDS_EN, lemmas=LEMMAS_EN) -> Column:
    """The lemmas of the light version."""
    return light_lemmas(clean_light(text), stops, lemmas)


def vectorizer_tokens(c) -> Column:
    """Lowercase, runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(J_VECTORIZER_TOKEN), 0)


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """All word n-grams for n in [n_min, n_max], joined by a blank,
    ordered by n then position (the order does not matter for counting). A
    gram is the shorter one that starts there and the next word."""
    grams, out = tokens, tokens if n_min == 1 else None
    for n in range(2, n_max + 1):
        grams = F.zip_with(F.slice(grams, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0))),
                           F.slice(tokens, n, F.greatest(F.size(tokens) - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= n_min:
            out = grams if out is None else F.concat(out, grams)
    return out


def encode_fixed(ids: Column, length: int, pad_id: int = 0) -> tuple[Column, Column]:
    """Truncate to ``length``, pad with ``pad_id``; mask 1 for real ids."""
    cut = F.slice(ids, 1, length)
    pad = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(cut), F.lit(0)))
    input_ids = F.concat(cut, pad)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))
    return input_ids, mask


def _shifted(logits: Column) -> Column:
    """exp(x - max) per element, the maximum computed once per row."""
    return let(F.struct(logits.alias("v"), F.array_max(logits).alias("m")),
               lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"])))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Numerically stable softmax over an array column, linear in its
    length (maximum and sum are bound once per row)."""
    return let(_shifted(logits), lambda e: let(F.struct(e.alias("e"), _total(e).alias("t")),
                                               lambda s: F.transform(s["e"], lambda x: x / s["t"])))


def confidence(logits: Column) -> Column:
    """The largest softmax value, 1 / sum(exp(x - max))."""
    return F.lit(1.0) / _total(_shifted(logits))


def argmax(values: Column) -> Column:
    """0-based position of the maximum; ties go to the lowest id."""
    return F.array_position(values, F.array_max(values)) - 1
