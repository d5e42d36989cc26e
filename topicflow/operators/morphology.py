"""Rule tokeniser and rule lemmatiser for four languages.

Tokens: a run between blanks loses opening marks at its front and closing marks
at its end one by one, unless it is listed as an exception (an abbreviation
keeps its point); then an elided article and a contracted ending come off, and
hyphens, slashes and dashes inside part it. All steps are JVM expressions.

Lemmas: distinct forms of a language are looked up in a list of irregular
forms; else every ending rule whose ending they have proposes a lemma, and a
proposal counts if the corpus itself holds it as a form often enough; the
longest ending wins. Forms without an accepted proposal are their own lemma.
Rules run once per distinct form and are joined back to the documents, so the
work grows with the vocabulary, and no list grows with it.

Edge cases: null and empty texts have no tokens; a null or unknown language has
the marks of the tokeniser but no endings, so its forms stay; upper-case forms
are looked up in lower case.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

# ---------------------------------------------------------------------------
# Rules of the languages' orthography.
# ---------------------------------------------------------------------------
OPENING = "([{<\"'`„“‚‘«‹¿¡*"
CLOSING = ")]}>\"'`”“’‘»›.,;:!?…*%"
INNER = "-/–—_"
EXCEPTIONS = {
    "en": "e.g. i.e. etc. mr. mrs. ms. dr. prof. st. vs. u.s. u.k. a.m. p.m. no. inc.",
    "de": "z.b. d.h. u.a. usw. bzw. ca. dr. prof. nr. str. s.o. vgl. evtl.",
    "fr": "m. mme. mlle. etc. p.ex. c.-à-d. av. bd. no. env.",
    "es": "sr. sra. srta. ud. uds. dr. dra. etc. p.ej. ee.uu. pág. núm.",
}
ELISIONS = {"fr": ["l", "d", "j", "n", "m", "t", "s", "c", "qu", "jusqu", "lorsqu", "puisqu"]}
CONTRACTIONS = {"en": ["n't", "'s", "'m", "'d", "'ll", "'re", "'ve"]}
# (ending, replacement); a form keeps MIN_STEM letters before its ending, a lemma has MIN_LEMMA
ENDINGS = {
    "en": [("s", ""), ("es", ""), ("ies", "y"), ("ves", "f"), ("ves", "fe"), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"),
           ("ied", "y"), ("er", ""), ("er", "e"), ("est", ""), ("est", "e"), ("ier", "y"), ("iest", "y"), ("men", "man")],
    "de": [("en", ""), ("en", "e"), ("n", ""), ("er", ""), ("e", ""), ("es", ""), ("s", ""), ("em", ""), ("ern", ""), ("st", "en"),
           ("t", "en"), ("te", "en"), ("ten", "en"), ("ungen", "ung"), ("heiten", "heit"), ("keiten", "keit"), ("innen", "in")],
    "fr": [("s", ""), ("x", ""), ("aux", "al"), ("eaux", "eau"), ("es", "e"), ("es", ""), ("e", ""), ("ées", "er"), ("ée", "er"),
           ("és", "er"), ("é", "er"), ("ait", "er"), ("ent", "er"), ("ant", "er"), ("ons", "er"), ("ez", "er"), ("euses", "eux"),
           ("euse", "eux"), ("ives", "if"), ("ive", "if")],
    "es": [("s", ""), ("es", ""), ("ces", "z"), ("as", "o"), ("a", "o"), ("ando", "ar"), ("iendo", "er"), ("iendo", "ir"), ("ado", "ar"),
           ("ada", "ar"), ("ados", "ar"), ("adas", "ar"), ("ido", "er"), ("ido", "ir"), ("aba", "ar"), ("ciones", "ción"), ("ó", "ar")],
}
IRREGULAR = {
    "en": "children:child men:man women:woman people:person mice:mouse feet:foot teeth:tooth went:go gone:go was:be were:be is:be are:be "
          "been:be had:have has:have did:do done:do said:say made:make took:take came:come saw:see got:get better:good best:good",
    "de": "ist:sein sind:sein war:sein waren:sein hat:haben hatte:haben wird:werden wurde:werden ging:gehen kam:kommen besser:gut "
          "männer:mann kinder:kind häuser:haus",
    "fr": "est:être sont:être était:être a:avoir ont:avoir va:aller vont:aller fait:faire yeux:oeil meilleur:bon",
    "es": "es:ser son:ser fue:ser era:ser ha:haber han:haber va:ir van:ir hizo:hacer mejor:bueno",
}
MIN_STEM, MIN_LEMMA = 2, 3
LEAST = 2                    # times a proposed lemma must occur in the corpus


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]{}()\\^-*.?" else c for c in chars) + "]"


def by_language(values: dict, make) -> Column:
    """``make`` of the row's language (column ``lang``); null for others."""
    out = None
    for k in sorted(values):
        out = F.when(F.col("lang") == k, make(values[k])) if out is None else out.when(F.col("lang") == k, make(values[k]))
    return out


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """Adds ``tokens`` to rows of (lang, chunk): a chunk stands between blanks."""
    opening, closing, inner = _class(OPENING), _class(CLOSING), _class(INNER)

    def listed(c):
        return F.coalesce(by_language(EXCEPTIONS, lambda v: F.lower(c).isin(v.split())), F.lit(False))

    def found(values, pattern, c):
        return F.coalesce(by_language(values, lambda v: F.regexp_extract(c, pattern % "|".join(v), 1)), F.lit(""))
    c = chunks.withColumn("_front", F.when(listed("chunk"), F.lit("")).otherwise(F.regexp_extract("chunk", f"^({opening}*)", 1)))
    c = c.withColumn("_rest", F.expr("substring(chunk, length(_front) + 1)"))
    c = c.withColumn("_listed", listed("_rest"))
    c = c.withColumn("_end", F.when(F.col("_listed"), F.lit("")).otherwise(F.regexp_extract("_rest", f"({closing}*)$", 1)))
    c = c.withColumn("_core", F.expr("left(_rest, length(_rest) - length(_end))"))
    c = c.withColumn("_elided", F.when(F.col("_listed"), F.lit("")).otherwise(found(ELISIONS, "(?i)^((?:%s)['’])", "_core")))
    c = c.withColumn("_contracted", F.when(F.col("_listed"), F.lit("")).otherwise(found(CONTRACTIONS, "(?i)(%s)$", "_core")))
    c = c.withColumn("_middle", F.expr("substring(_core, length(_elided) + 1, length(_core) - length(_elided) - length(_contracted))"))
    parts = F.when(F.col("_listed"), F.array("_middle")).otherwise(
        F.regexp_extract_all("_middle", F.lit(f"{inner.replace('[', '[^', 1)}+|{inner}"), F.lit(0)))
    tokens = F.filter(F.concat(F.split("_front", ""), F.array("_elided"), parts, F.array("_contracted"), F.split("_end", "")), lambda t: t != "")
    return c.withColumn("tokens", tokens).drop("_front", "_rest", "_listed", "_end", "_core", "_elided", "_contracted", "_middle")


def _chunks(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda c: c != "")


def tokenize(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(doc, lang, tokens) in order: the rules see every distinct chunk of a
    language once."""
    flat = docs.select(id_col, F.col(lang_col).alias("lang"), F.posexplode_outer(_chunks(text_col)).alias("pos", "chunk"))
    table = chunk_tokens(flat.where(F.col("chunk").isNotNull()).select("lang", "chunk").distinct())
    t = table.select(F.col("lang").alias("_lang"), F.col("chunk").alias("_chunk"), "tokens")
    met = flat.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("chunk") == F.col("_chunk")), "left")
    rows = met.groupBy(id_col, "lang").agg(F.array_sort(F.collect_list(F.when(F.col("tokens").isNotNull(), F.struct("pos", "tokens")))).alias("p"))
    return rows.select(id_col, "lang", F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"))


def forms(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, form, n): distinct lower-case word forms of each language."""
    chunks = (docs.select(F.col(lang_col).alias("lang"), F.explode(_chunks(text_col)).alias("chunk"))
              .groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n")))
    return (chunk_tokens(chunks).select("lang", "n", F.explode("tokens").alias("t")).select("lang", "n", F.lower("t").alias("form"))
            .where(F.col("form").rlike(r"^\p{L}+$")).groupBy("lang", "form").agg(F.sum("n").alias("n")))


def rules_table(spark) -> DataFrame:
    """(lang, ending, put, k): the ending rules; k is their place."""
    return spark.createDataFrame([(g, e, p, k) for g, rules in ENDINGS.items() for k, (e, p) in enumerate(rules)],
                                 "lang string, ending string, put string, k int")


def irregular_table(spark) -> DataFrame:
    return spark.createDataFrame([(g, *w.split(":")) for g, words in IRREGULAR.items() for w in words.split()],
                                 "lang string, form string, irregular string")


def lemma_table(words: DataFrame, least: int = LEAST, min_stem: int = MIN_STEM) -> DataFrame:
    """(lang, form, n, lemma) from (lang, form, n). Proposals meet the forms
    they name by a join on (lang, form)."""
    spark = words.sparkSession
    longest = max(len(e) for rules in ENDINGS.values() for e, _ in rules)
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(k.alias("k"), F.right("form", k).alias("ending"))))
    cut = (words.where(F.length("form") > min_stem).select("lang", "form", tails.alias("x"))
           .where(F.length("form") - F.col("x.k") >= min_stem).select("lang", "form", F.col("x.ending").alias("ending")))
    proposed = (cut.join(broadcast_if_small(rules_table(spark)), ["lang", "ending"])
                .withColumn("lemma", F.concat(F.left("form", F.length("form") - F.length("ending")), F.col("put"))))
    known = words.where((F.col("n") >= least) & (F.length("form") >= MIN_LEMMA)).select("lang", F.col("form").alias("lemma"))
    best = (proposed.where("lemma <> form").join(known, ["lang", "lemma"])
            .groupBy("lang", "form").agg(F.min_by("lemma", F.struct(-F.length("ending"), "k")).alias("ruled")))
    out = words.join(best, ["lang", "form"], "left").join(broadcast_if_small(irregular_table(spark)), ["lang", "form"], "left")
    return out.select("lang", "form", "n", F.coalesce("irregular", "ruled", "form").alias("lemma"))


def lemmatize(docs: DataFrame, lemmas: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(doc, lemmas): the rule tokens of each text with their lemmas in place.
    The lemma of a chunk's tokens is found once per distinct chunk."""
    flat = docs.select(id_col, F.col(lang_col).alias("lang"), F.posexplode_outer(_chunks(text_col)).alias("pos", "chunk"))
    table = chunk_tokens(flat.where(F.col("chunk").isNotNull()).select("lang", "chunk").distinct())
    one = table.select("lang", "chunk", F.posexplode("tokens").alias("i", "t")).withColumn("form", F.lower("t"))
    changed = lemmas.where("lemma <> form").select("lang", "form", "lemma")
    named = (one.join(changed, ["lang", "form"], "left").groupBy("lang", "chunk")
             .agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("lemma", "t").alias("w")))).alias("p"))
             .select(F.col("lang").alias("_lang"), F.col("chunk").alias("_chunk"), F.transform("p", lambda x: x["w"]).alias("words")))
    met = flat.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("chunk") == F.col("_chunk")), "left")
    rows = met.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("pos", "words")))).alias("p"))
    return rows.select(id_col, F.flatten(F.transform("p", lambda x: x["words"])).alias("lemmas"))
