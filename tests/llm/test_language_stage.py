"""The language stage keeps texts of learned languages and rejects the rest."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import langid

SF = "/root/testdata/sf0.001"
FINNISH = "Suomen kieli on uralilaisiin kieliin kuuluva kieli jota puhutaan pääosin Suomessa ja sillä on virallisen kielen asema"
STRANGE = [FINNISH, "日本語の文章はここにあります", "Привет как дела сегодня хорошо", "xqzj wvkq zzxj qpwk vjxq kqzw"]


def test_unlearned_languages_and_random_letters_go(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz    ")
    strange = STRANGE + ["".join(rng.choice(letters, n)) for n in (40, 200, 2000) for _ in range(5)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    added = spark.createDataFrame([(10**6 + i, x, None) for i, x in enumerate(strange)], docs.schema)
    kept = {r.doc_id for r in langid.known_language(docs.unionByName(added)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_texts_of_a_language_left_out_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    blind = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))  # French is there, but never learned
    kept = langid.known_language(blind).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n = {r.truth: r["count"] for r in docs.groupBy(F.col("lang").alias("truth")).count().collect()}
    got = {r.truth: r["count"] for r in kept.groupBy("truth").count().collect()}
    assert got.get("fr", 0) <= 0.1 * n["fr"]
    assert all(got[x] == n[x] for x in n if x != "fr")


def test_no_known_gram_is_the_first_language_with_no_score():
    filters = langid.filled({"de": langid.grams(langid.letters("der die das")), "en": langid.grams(langid.letters("the of"))}, 1 << 12)
    assert filters.judge("日本語") == ("de", 0.0, 0.0) and filters.predict("12 !") == ("und", 0.0) and filters.predict("die")[0] == "de"


def test_all_labelled_rows_count(spark):
    """More rows of a language than a sample of 3,000: each is counted."""
    docs = spark.range(5_000).selectExpr("id doc_id", "if(id % 2 = 0, 'der', 'das') text", "'de' lang")
    grams, shares = langid.top_grams(docs, 10_000)["de"]
    n = dict(zip(grams.tolist(), (shares / shares.min()).tolist(), strict=True))
    one = {w: set(langid.grams(langid.letters(w)).tolist()) for w in ("der", "das")}
    assert all(n[g] == (2 if g in one["der"] & one["das"] else 1) for g in one["der"] | one["das"])


class Told:
    """A model whose shares stand in the text."""

    def shares(self, text, lang):
        return float(text.split()[1]), 0.0, 0.0


def test_bounds_are_quantiles_of_all_rows(spark):
    """4,000 rows whose lowest shares a sample of a thousand would mostly miss: the bound is the exact low quantile."""
    rows = [(f"x {i / 8000}", "de") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1))
    quarter = 0.25 * np.quantile([i / 8000 for i in range(4_000)], 0.01)
    assert abs(langid.share_bounds(docs, Told())["de"] - min(quarter, 3 / 8000)) < 2e-6
