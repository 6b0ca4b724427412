"""N-grams counted in tasks from words, against the arrays of ``functions/ngrams.py`` and Spark ML's own stages."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import gramcounts
from plumbline.operators import modeling

TEXTS = ["a b a b c", "", None, "Été \U0001F389x   naïve İstanbul ß", "x" * 40, "same words same words", "one",
         " ".join(f"w{i % 50}" for i in range(400)), "same words same words"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, "Shop", "Food", "") for i, t in enumerate(TEXTS)],
                               "review_id long, review_text string, biz_name string, biz_cats string, biz_desc string")
    return modeling.add_grams(df)


@pytest.mark.parametrize("terms,words,at_once", [(400_000, 200_000, 100_000), (20, 3, 5)])
@pytest.mark.parametrize("grams", ["_char_grams", "_word_grams"])
def test_totals_are_those_of_the_arrays(rows, monkeypatch, grams, terms, words, at_once):
    monkeypatch.setattr(gramcounts, "HELD_TERMS", terms)
    monkeypatch.setattr(gramcounts, "HELD_WORDS", words)
    monkeypatch.setattr(gramcounts, "WORDS_AT_ONCE", at_once)
    plain = [(r["review_id"], Counter(r[grams])) for r in rows.select("review_id", grams).collect()]
    found = {r["term"]: r for r in modeling._totals(rows, grams).collect()}
    assert {t: (r["cnt"], r["df"]) for t, r in found.items()} == {
        t: (sum(c[t] for _, c in plain), sum(t in c for _, c in plain)) for t in set().union(*[c for _, c in plain])}
    columns = {t: tuple((i, c[t]) for i, c in plain if t in c) for t in found}
    assert len({(r["left"], r["right"]) for r in found.values()}) == len(set(columns.values()))


def test_tasks_hand_on_one_row_a_term():
    words = pa.array([["same", "words"]] * 1000, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_pydict({"_of": words, "_number": pa.array(range(1000))})
    out = pa.Table.from_batches(gramcounts.totals(gramcounts.WORDS)([batch]))
    assert sorted(out["term"].to_pylist()) == ["same", "same words", "words"] and set(out["df"].to_pylist()) == {1000}


@pytest.mark.parametrize("min_df", [1, 2])
def test_vectors_are_those_of_the_stages(rows, min_df):
    model = modeling.fit_tfidf(rows, min_df)
    plain = modeling.apply_stages(rows, model.stages, modeling.vector_sizes(model.stages))
    found = {r[0]: r[1] for r in modeling.add_vectors(rows, model).select("review_id", F.col("tfidf")).collect()}
    assert found == {r[0]: r[1] for r in plain.select("review_id", F.col("tfidf")).collect()}
    assert "Generate" not in modeling._totals(rows, "_char_grams")._jdf.queryExecution().executedPlan().toString()
