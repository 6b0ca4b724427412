import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions.ngrams import word_ngrams, words
from plumbline.operators import rules, similarity
from plumbline.schemas import TASKS

# Invented reviews of four invented businesses.
SHOPS = {
    "b1": ("Luna Trattoria", "Restaurant, Italian", "Wood oven pizza and fresh pasta"),
    "b2": ("Quiet Stones", "Spa, Wellness", "Hot stone massage and sauna"),
    "b3": ("Volt Corner", "Electronics", "Repair of phones and laptops"),
    "b4": ("", "", ""),
}
REVIEWS = [
    ("1", "b1", "The pizza from the wood oven and the fresh pasta were lovely pizza"),
    ("2", "b1", "My laptop is slow"),
    ("3", "b1", "See https://win.example for a coupon"),
    ("4", "b2", "I heard the sauna is dirty"),
    ("5", "b2", "hot stone massage, hot stone massage"),
    ("6", "b3", "Repair of phones and laptops: great repair"),
    ("7", "b3", ""),
    ("8", "b4", "nothing known here"),
    ("9", "b2", "They sold me a GPU"),
    ("10", "b1", "a b c"),
]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, b, *SHOPS[b], t) for i, b, t in REVIEWS]
    return spark.createDataFrame(
        rows, "review_id string, business_id string, biz_name string, biz_cats string, "
        "biz_desc string, review_text string")


def terms(text):
    tokens = re.findall(r"\w\w+", text.lower())
    return Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])


def plain_cosine(left, right, df, n):
    def idf(t):
        return math.log((1 + n) / (1 + df[t])) + 1

    a, b = terms(left), terms(right)
    na, nb = (math.sqrt(sum((c * idf(t)) ** 2 for t, c in d.items())) for d in (a, b))
    return sum(a[t] * b[t] * idf(t) ** 2 for t in a) / (na * nb) if na and nb else 0.0


def shop_text(b):
    return " ".join(SHOPS[b]).strip()


def corpus_expected():
    docs = [t for _, _, t in REVIEWS] + [shop_text(b) for _, b, _ in REVIEWS]
    df = Counter(t for d in docs for t in terms(d))
    return {i: plain_cosine(t, shop_text(b), df, len(docs)) for i, b, t in REVIEWS}


def pair_expected():
    out = {}
    for i, b, t in REVIEWS:
        df = Counter(list(terms(t)) + list(terms(shop_text(b))))
        out[i] = plain_cosine(t, shop_text(b), df, 2)
    return out


def close(found, expected):
    assert found.keys() == expected.keys()
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, abs=1e-12), k


def test_corpus_cosine(reviews):
    labeled = rules.rules_label(reviews).collect()
    close({r["review_id"]: r["cosine_to_business"] for r in labeled}, corpus_expected())


def test_hot_and_cold_terms_give_the_same(reviews):
    clean = rules.normalize_for_rules(reviews)
    plain = similarity.corpus_cosine(clean, "norm_text", "norm_biz").collect()
    # No broadcast of the whole table, and a low bar for hot terms.
    split = similarity.corpus_cosine(
        clean, "norm_text", "norm_biz", broadcast_terms=0, hot_terms=20).collect()
    close(dict(map(tuple, split)), dict(map(tuple, plain)))


def test_pair_cosine(reviews):
    labeled = rules.rules_label(reviews, scope="pair").collect()
    close({r["review_id"]: r["cosine_to_business"] for r in labeled}, pair_expected())


def test_labels(reviews):
    got = {r["review_id"]: r for r in rules.rules_label(reviews).collect()}
    assert {i for i, r in got.items() if r["ads"]} == {"3"}
    assert {i for i, r in got.items() if r["rant_no_visit"]} == {"4"}
    assert {i for i, r in got.items() if r["offtopic"]} == {"2", "9"}
    expected = {i for i, c in corpus_expected().items() if c < 0.25} | {"2", "9"}
    assert {i for i, r in got.items() if r["irrelevant"]} == expected
    assert all(r["relevant"] + r["irrelevant"] == 1 for r in got.values())
    assert got["3"]["reasons"] == ["ads: url/phone/promo", "irrelevant: cosine<0.25"]


def test_rows_in_equal_rows_out(reviews):
    """Labels are columns of one plan, whatever the partitions."""
    assert rules.rules_label(reviews.repartition(7)).count() == len(REVIEWS)
    assert set(TASKS) <= set(rules.rules_label(reviews).columns)


def test_policy_table(spark, tmp_path):
    import json

    from plumbline.policy import DEFAULT_POLICY, load_policy

    table = DEFAULT_POLICY.to_table(spark)
    assert table.filter("kind = 'keyword'").count() == len(DEFAULT_POLICY.keywords)
    path = tmp_path / "policy.json"
    doc = {
        "ads": {"url_regex": ["x"], "phone_regex": [], "keywords": ["y"]},
        "irrelevant": {"min_cosine_to_business": 0.5},
        "rant_no_visit": {"positive_cues": ["z"]},
    }
    path.write_text(json.dumps(doc))
    assert load_policy(str(path)).min_cosine == 0.5


def test_small_bounds_give_the_same(reviews):
    """Hot and cold terms, and a dictionary too large to broadcast."""
    clean = rules.normalize_for_rules(reviews)
    plain = similarity.corpus_cosine(clean, "norm_text", "norm_biz").collect()
    split = similarity.corpus_cosine(
        clean, "norm_text", "norm_biz", broadcast_terms=0, hot_terms=20, broadcast_texts=0).collect()
    close(dict(map(tuple, split)), dict(map(tuple, plain)))


def test_each_business_text_is_one_row(spark, reviews):
    """A text many reviews share is one row of the dictionary, null is not empty, and cells do not run together."""
    schema = "biz_name string, biz_cats string, biz_desc string"
    rows = [("a", "b", None)] * 50 + [("a", "b", "")] * 3 + [("ab", "", None), ("a", "b:1", None), (None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumnsRenamed({c: f"_{c}" for c in rules.BUSINESS_TEXTS})
    found = rules.business_dictionary(df).collect()
    assert sorted(r["uses"] for r in found) == [1, 1, 1, 3, 50]
    assert len({bytes(r["_biz"]) for r in found}) == 5


def test_shared_texts_count_as_often_as_they_stand(reviews):
    clean = rules.normalize_for_rules(reviews)
    plain = dict(map(tuple, similarity.doc_freq(clean, "norm_text", "norm_biz").collect()))
    assert dict(map(tuple, similarity.doc_freq(clean, "norm_text", shared=("norm_biz",)).collect())) == plain


def exchanged_columns(df):
    """Columns of every exchange in the plan."""
    import re

    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


@pytest.mark.parametrize("bound, most", [(200_000, 0), (0, 1)])
def test_words_of_reviews_move_at_most_once(spark, reviews, tmp_path, bound, most):
    """Not at all beside a small dictionary, once beside a large one, and no business text moves with them."""
    base = reviews.select("review_id", words(F.col("review_text")).alias("_words"), similarity.text_key("biz_name").alias("_biz"))
    base.write.parquet(str(tmp_path / "r"))
    shops = similarity.dictionary(reviews, "biz_name").select(
        similarity.text_key("biz_name").alias("_biz"), "uses", word_ngrams(F.col("biz_name")).alias("_terms"))
    shops.write.parquet(str(tmp_path / "b"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the tables here are tiny
    try:
        scored = similarity.dictionary_cosine(
            spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "b")), "review_id",
            broadcast_texts=bound, max_hot_texts=1)
        moved = exchanged_columns(scored)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved and sum("_words" in columns for columns in moved) == most
    assert not any("_words" in columns and "_marked" in columns for columns in moved)
    assert scored.count() == reviews.count()


def test_reviews_without_words_are_labeled(spark):
    """Null and empty texts, one-letter words, null business cells, repeated rows."""
    rows = [("1", "s", None, "n", "spa", "d"), ("2", "s", "", None, None, None), ("3", "s", "a b", "n", "spa", "d"),
            ("4", "s", "a gpu", "n", "spa", None), ("4", "s", "a gpu", "n", "spa", None)]
    df = spark.createDataFrame(rows, "review_id string, business_id string, review_text string, biz_name string, biz_cats string, biz_desc string")
    found = rules.rules_label(df).collect()
    assert sorted(r["review_id"] for r in found) == ["1", "2", "3", "4", "4"]
    assert {r["review_id"] for r in found if r["offtopic"]} == {"4"}
    assert all(r["cosine_to_business"] == 0.0 for r in found)
    assert rules.rules_label(df.limit(0)).count() == 0


def test_terms_are_counted_as_numbers_not_row_by_row(spark, reviews):
    """Numbers made in tasks are those Spark gives the terms; a row's terms are not sorted as strings."""
    import numpy as np

    from plumbline.functions import counting

    text = spark.createDataFrame([("été gpu",), ("gpu",)], "t string")
    a, b = (r[0] for r in text.select(counting.word_numbers(F.split("t", " "))).collect())
    pair, word = (r[0] for r in text.select(counting.term_number(F.col("t"))).collect())
    assert word == b[0] == a[1] and pair == counting.pair_numbers(np.array(a[:1]), np.array(a[1:]))[0]

    table = rules.normalize_for_rules(reviews)
    plan = similarity.corpus_cosine(table, "norm_text", "norm_biz")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sort_array" not in plan


def test_a_long_row_is_one_part_and_others_are_cut(monkeypatch):
    import pyarrow as pa

    from plumbline.functions import counting

    monkeypatch.setattr(counting, "PART", 4)
    rows = [[1, 1], None, [2, 3, 2, 3, 2, 3], [], [1, 2], [1, 2]]
    batch = pa.RecordBatch.from_pydict({"_ids": pa.array(rows, pa.list_(pa.int64())), "uses": pa.array([1, 1, 1, 1, 1, 5])})
    got = [b["_ids"].to_pylist() for b in counting.parts([batch], "_ids")]
    assert len(got) > 1 and sum(got, []) == rows
    df = {}
    for b in counting.frequencies(False)([batch]):
        for i, n in zip(b["id"].to_pylist(), b["df"].to_pylist(), strict=True):
            df[i] = df.get(i, 0) + n
    assert df == {1: 7, 2: 7, 3: 1}


def test_postings_and_frequencies_move_packed(reviews, monkeypatch):
    """Terms over many buckets give what one bucket gives, and no term is a row of its own that joins its weight."""
    clean = rules.normalize_for_rules(reviews)
    plain = similarity.corpus_cosine(clean, "norm_text", "norm_biz").collect()
    written, materialize = {}, similarity.materialize

    def noted(df, name):
        written[name] = table = materialize(df, name)
        return table

    monkeypatch.setattr(similarity, "materialize", noted)
    monkeypatch.setattr(similarity, "LEAST_POSTINGS", 20)
    split = similarity.corpus_cosine(clean, "norm_text", "norm_biz", broadcast_terms=0, hot_terms=1)
    close(dict(map(tuple, split.collect())), dict(map(tuple, plain)))
    buckets = written["term-table"].agg(F.count_distinct("bucket"), F.count("bucket"), F.sum("n")).first()
    assert 1 < buckets[0] == buckets[1] < buckets[2]
    assert not any(re.search(r"\bid#", columns) for columns in exchanged_columns(split))


def test_reviews_under_one_key_are_summed_over_buckets(reviews, monkeypatch):
    """Rows of one key count as one document, wherever their terms lie; unknown terms of a frozen table count as rare."""
    clean = rules.normalize_for_rules(reviews.unionByName(reviews.filter("review_id < '5'")))
    frozen = dict(terms=similarity.doc_freq(clean, "norm_text", "norm_biz").filter("df > 1"), n_docs=28)
    monkeypatch.setattr(similarity, "LEAST_POSTINGS", 20)
    for given in ({}, frozen):
        plain = similarity.corpus_cosine(clean, "norm_text", "norm_biz", **given).collect()
        split = similarity.corpus_cosine(clean, "norm_text", "norm_biz", broadcast_terms=0, hot_terms=5, **given).collect()
        assert len(split) == len(plain) > 0
        close(dict(map(tuple, split)), dict(map(tuple, plain)))
