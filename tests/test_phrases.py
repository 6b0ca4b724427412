"""Policies as tables, against trying every phrase on every text."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions.patterns import any_phrase
from plumbline.operators import phrases, rules
from plumbline.policy import DEFAULT_POLICY, policy_from_table

TEXTS = [
    "call now", "recall nowhere", "50% off today", "50 % offer", "i heard it", "kelvin was here", "ſpa day",
    "a\\eb and a.b", "straße", "", None, "the the the", "don't try", "x%%y", "x%% y", "the end", "50% off today",
]
PATTERNS = [
    "call now", "% off", "i heard", "Kelvin", "spa day", "a\\Eb", "a.b", "STRAẞE", "the", "didn't try", "don't try", "%%", "y", "", None,
    "never there", "the end", "the",
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("phrases") / "t")
    rows = [(i, t, f"shop {i}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "id long, text string, patterns string").write.parquet(path)
    return spark.read.parquet(path)


def policy(spark, patterns, kind="keyword", category=None):
    return spark.createDataFrame([(kind, category, p) for p in patterns], "kind string, category string, pattern string")


@pytest.mark.parametrize("broadcast_words", [1000, 0])
def test_matches_are_those_of_every_phrase_on_every_text(spark, table, broadcast_words):
    found = phrases.phrase_matches(
        table.withColumnRenamed("patterns", "extra"), policy(spark, PATTERNS), "text", "id", broadcast_words, 2)
    got = {r["id"]: r["matched"] for r in found.collect()}
    tried = {p: table.filter(any_phrase(F.col("text"), [p])).select("id").collect() for p in PATTERNS if p}
    expected = {}
    for p, rows in tried.items():
        for r in rows:
            expected.setdefault(r["id"], []).append(p)
    assert got == {i: sorted(set(ps)) for i, ps in expected.items()}
    assert got[5] == ["Kelvin"] and got[6] == ["spa day"] and 1 not in got


def test_rarest_word_is_the_key(spark):
    held = spark.createDataFrame([(i, "THE") for i in range(9)] + [(1, "END"), (2, "END"), (3, "X")], "row long, word string")
    rows = spark.createDataFrame([("the end",), ("the",), ("the x end",), ("nothing else",)], "pattern string")
    found = {r["word"]: sorted(p["pattern"] for p in r["patterns"]) for r in phrases.phrase_dictionary(held, rows).collect()}
    assert found == {"END": ["the end"], "THE": ["the"], "X": ["the x end"]}


def test_empty_tables(spark, table):
    none = policy(spark, ["x"]).limit(0)
    assert phrases.phrase_matches(table, none, "text", "id").count() == 0
    reviews = spark.createDataFrame([("1", "call now", "Spa"), ("1", "call now", "Spa"), (None, None, None)],
                                    "review_id string, review_text string, biz_cats string")
    assert [tuple(r)[1:] for r in phrases.phrase_counts(reviews, none).collect()] == [(0, 0, 0)] * 3
    assert phrases.phrase_counts(reviews.limit(0), policy(spark, ["x"])).count() == 0
    found = phrases.phrase_counts(reviews, policy(spark, ["call now", "call"])).collect()
    assert sorted((tuple(r) for r in found), key=str) == [("1", 2, 0, 0), ("1", 2, 0, 0), (None, 0, 0, 0)]


def test_foreign_to_two_categories_counts_once(spark):
    reviews = spark.createDataFrame([("1", "my gpu", "Spa, Park"), ("2", "my gpu", "Bar")],
                                    "review_id string, review_text string, biz_cats string")
    rows = policy(spark, ["gpu"], "off_topic", "Spa").union(policy(spark, ["gpu"], "off_topic", "park"))
    assert {r[0]: r["offtopic_phrases"] for r in phrases.phrase_counts(reviews, rows).collect()} == {"1": 1, "2": 0}


def test_too_many_wordless_phrases(spark, table):
    rows = policy(spark, ["%" * n for n in range(1, phrases.MAX_WORDLESS + 3)])
    with pytest.raises(ValueError, match="no word"):
        phrases.phrase_matches(table, rows, "text", "id")


def test_text_does_not_move_with_words(spark, table):
    """The words of all texts are exploded beside the key alone."""
    held = table.select("id", F.explode(phrases.folded_words(F.col("text"))).alias("word"))
    text = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate explode\(.*\), \[id#\d+L\]", text)


def test_policy_from_table(spark):
    back = policy_from_table(DEFAULT_POLICY.to_table(spark))
    assert set(back.keywords) == set(DEFAULT_POLICY.keywords) and back.min_cosine == DEFAULT_POLICY.min_cosine
    assert {k: set(v) for k, v in back.off_topic.items()} == {k: set(v) for k, v in DEFAULT_POLICY.off_topic.items()}
    with pytest.raises(ValueError, match="more than"):
        policy_from_table(DEFAULT_POLICY.to_table(spark), most=3)
    df = spark.createDataFrame([("1", "call now", "Spa")], "review_id string, review_text string, biz_cats string")
    hit = rules.ads_hit(F.col("review_text"), back)
    assert df.select(hit).first()[0]


def test_key_is_the_rarest_pair(spark, table, monkeypatch):
    """Words that all texts hold give no candidates where their pairs are rare."""
    rows = [(i, f"one two three {i}" if i else "three two one") for i in range(50)]
    texts = spark.createDataFrame(rows, "id long, text string")
    met = []
    join = phrases.lookup_join

    def seen(held, words, *args, **options):
        met.append(join(held, words, *args, **options).filter("patterns is not null").count())
        return join(held, words, *args, **options)

    monkeypatch.setattr(phrases, "lookup_join", seen)
    found = phrases.phrase_matches(texts, policy(spark, ["three two", "two one", "three two one"]), "text", "id")
    assert [tuple(r) for r in found.collect()] == [(0, ["three two", "three two one", "two one"])]
    assert met[0] <= 2


def test_marks_are_the_boundaries_of_words(spark):
    texts = ["a, b", "aa, b", "a, bb", ", b", "x a, b y", "a\x01, b", "İa, b", "ﬁ, b", "A, ß", "a, ƛ", "über, ÉTÉ", "ͅa, b"]
    wanted = ["a, b", ", b", "a,", " b", "A, B", "fi, b", "a, ss", "a, ß", "a, Ƛ", "ÜBER, été", "\x01, b", "b"]
    rows = spark.createDataFrame([(t, p) for t in texts for p in wanted], "t string, p string")
    marked = phrases.marked_words(F.col("t")).contains(phrases.marked_phrase(F.col("p")))
    plain = phrases.is_plain(F.col("t")) & phrases.is_plain(F.col("p"))
    tried = rows.select("t", "p", marked.alias("m"), F.rlike("t", phrases.whole_words(F.col("p"))).alias("r"), plain.alias("plain")).collect()
    assert [(x["t"], x["p"]) for x in tried if x["plain"] and x["m"] != x["r"]] == []
    assert sum(x["plain"] for x in tried) > 60 and not any(x["plain"] for x in tried if x["t"] in ("a, ƛ", "a\x01, b"))
