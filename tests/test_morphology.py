"""Rule tokens and lemmas: golden rows of four languages, coverage."""
import pytest
from pyspark.sql import functions as F

from topicflow.operators import morphology as M

TOKENS = [
    ("en", "He said: \"Don't go, e.g. to Mr. Smith's (old) well-known shop...\"",
     ["He", "said", ":", '"', "Do", "n't", "go", ",", "e.g.", "to", "Mr.", "Smith", "'s", "(", "old", ")", "well", "-", "known", "shop",
      ".", ".", ".", '"']),
    ("de", "Das ist z.B. „gut“, usw. und/oder nicht!", ["Das", "ist", "z.B.", "„", "gut", "“", ",", "usw.", "und", "/", "oder", "nicht", "!"]),
    ("fr", "L'eau qu'il boit, c'est «bon» ?", ["L'", "eau", "qu'", "il", "boit", ",", "c'", "est", "«", "bon", "»", "?"]),
    ("es", "¿Qué dice el Sr. Pérez? ¡Nada!", ["¿", "Qué", "dice", "el", "Sr.", "Pérez", "?", "¡", "Nada", "!"]),
    ("xx", "l'eau don't e.g.", ["l'eau", "don't", "e.g", "."]),
    (None, "(a) b.", ["(", "a", ")", "b", "."]),
    ("en", "", []), ("en", None, []), ("en", " \n\t ", []), ("en", "...", [".", ".", "."]), ("en", "3.5% a/b--c", ["3.5", "%", "a", "/", "b", "-", "-", "c"]),
]


def test_golden_tokens(spark):
    df = spark.createDataFrame([(i, g, t) for i, (g, t, _) in enumerate(TOKENS)], "i int, lang string, text string")
    got = {r.i: r.t for r in M.tokenize(df, "i").withColumnRenamed("tokens", "t").collect()}
    for i, (_, text, want) in enumerate(TOKENS):
        assert got[i] == want, text


def lemmas(spark, words):
    rows = [(g, f, n) for g, f, n in words]
    return {(r.lang, r.form): r.lemma for r in M.lemma_table(spark.createDataFrame(rows, "lang string, form string, n long")).collect()}


def test_golden_lemmas(spark):
    words = [("en", w, 3) for w in "walk walks walked walking make making cities city wolves wolf children running bus quickly".split()]
    words += [("de", w, 3) for w in "haus frau frauen zeitung zeitungen machen macht ist kinder".split()]
    words += [("fr", w, 3) for w in "cheval chevaux grand grande grandes parler parlé heureux heureuse est".split()]
    words += [("es", w, 3) for w in "luz luces hablar hablando nación naciones gato gatas es".split()]
    words += [("en", "rarest", 3), ("en", "rare", 1), (None, "walks", 3), ("xx", "walks", 3)]
    got = lemmas(spark, words)
    want = {("en", "walks"): "walk", ("en", "walked"): "walk", ("en", "walking"): "walk", ("en", "making"): "make", ("en", "cities"): "city",
            ("en", "wolves"): "wolf", ("en", "children"): "child", ("en", "running"): "running", ("en", "bus"): "bus", ("en", "city"): "city",
            ("de", "frauen"): "frau", ("de", "zeitungen"): "zeitung", ("de", "macht"): "machen", ("de", "ist"): "sein", ("de", "kinder"): "kind",
            ("fr", "chevaux"): "cheval", ("fr", "grandes"): "grande", ("fr", "grande"): "grand", ("fr", "parlé"): "parler",
            ("fr", "heureuse"): "heureux", ("fr", "est"): "être", ("es", "luces"): "luz", ("es", "hablando"): "hablar",
            ("es", "naciones"): "nación", ("es", "gatas"): "gato", ("es", "es"): "ser",
            ("en", "rarest"): "rarest", (None, "walks"): "walks", ("xx", "walks"): "walks"}        # a proposal must occur often enough
    assert {k: got[k] for k in want} == want and len(got) == len(words)


def test_documents_and_coverage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = M.forms(docs).persist()
    table = M.lemma_table(words).persist()
    assert table.count() == words.count()
    share = {r.lang: r.c for r in table.groupBy("lang").agg((F.sum(F.when(F.col("lemma") != F.col("form"), F.col("n")).otherwise(0))
                                                            / F.sum("n")).alias("c")).collect()}
    assert set(share) == {"en", "de", "fr", "es"} and all(0.002 < c < 0.9 for c in share.values()), share
    out = M.lemmatize(docs, table)
    plain = M.tokenize(docs).select("doc_id", F.size("tokens").alias("n"))
    assert out.join(plain, "doc_id").where(F.size("lemmas") != F.col("n")).count() == 0 and out.count() == docs.count()
