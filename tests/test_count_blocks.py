"""Blocks of counts against plain numpy, vocabularies cut by cells, and what a task holds at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array

from plumbline.functions import counting, gramcounts, ngrams
from plumbline.operators import modeling, similarity, solver
from pyspark.sql import functions as F

ROWS = [(i, f"word{i % 3} Été{i % 5} \U0001F389 call now{i % 2} {'x' * (i % 7)} a b a", "Shop", None if i % 4 else "Food", "", i % 2) for i in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    names = "review_id long, review_text string, biz_name string, biz_cats string, biz_desc string, label int"
    return modeling.add_grams(spark.createDataFrame([*ROWS, (60, "", None, None, None, 1), (61, None, None, None, None, 0)], names).coalesce(2))


@pytest.mark.parametrize("letters", [gramcounts.LETTERS, 9])
def test_slopes_of_counts_are_those_of_the_vectors(spark, rows, monkeypatch, letters):
    monkeypatch.setattr(solver, "BLOCK_CELLS", 2_000)
    monkeypatch.setattr(solver, "PIECE", 64)
    monkeypatch.setattr(gramcounts, "WORDS_AT_ONCE", 40)
    monkeypatch.setattr(gramcounts, "LETTERS", letters)  # others are cut one by one
    fitted = modeling.fit_blocks(rows, 1)
    vectors = modeling.add_vectors(rows, modeling.vectorizer(fitted)).withColumn("d", F.col("review_id") / 7)
    found = vectors.select("review_id", vector_to_array("tfidf").alias("x"), "label").toPandas().sort_values("review_id")
    x = np.column_stack([np.stack(found["x"]), found["review_id"] / 7])
    y, n, size = found["label"].to_numpy(), len(found), x.shape[1]
    columns, kinds = zip(*[modeling.MADE_OF[b.grams] for b in fitted])
    made_of = solver.Counted(columns, kinds, [(b.terms, b.idf) for b in fitted], ["d"])
    blocks = solver.count_blocks(rows.withColumn("d", F.col("review_id") / 7), made_of, ["label"]).toPandas()
    assert len(blocks) > 3 and blocks["n"].sum() == n
    rng = np.random.default_rng(1)
    w, balance = rng.normal(size=(1, size + 1)), np.array([[1.0, 2.0]])
    scale = np.concatenate([*[b.idf for b in fitted], [1.0]])
    shared = spark.sparkContext.broadcast(np.append(w[0, :size] * scale, w[0, size])[None])
    [flat] = list(solver.summed(solver.count_slopes(size, 1, shared, balance, [0], 1)(iter([blocks]))))
    got = np.concatenate([np.frombuffer(v) for _, v in sorted(zip(flat["slice"], flat["values"]))])
    margin, cost = x @ w[0, :-1] + w[0, -1], balance[0, y]
    miss = cost * (1 / (1 + np.exp(-margin)) - y)
    loss = (cost * (np.logaddexp(0, margin) - y * margin)).sum()
    np.testing.assert_allclose(np.append(got[:size] * scale, got[size:]), [*(x.T @ miss), miss.sum(), loss], rtol=1e-9, atol=1e-10)
    [moments] = list(solver.count_curvature(1, 1, balance)(iter([blocks])))
    z = np.column_stack([x[:, -1:], np.ones(n)])
    np.testing.assert_allclose(np.frombuffer(moments["moments"][0]).reshape(2, 2), (z * cost[:, None]).T @ z / 4, rtol=1e-9)


def test_vectors_leave_a_task_part_by_part(monkeypatch):
    """A batch of words several times a part long never stands whole as vectors."""
    monkeypatch.setattr(gramcounts, "WORDS_AT_ONCE", 30)
    words = pa.array([["some", "plain", "words"]] * 100, pa.list_(pa.string()))
    books = type("Books", (), {"value": [(pa.array(["some", "plain words"]), np.ones(2))]})
    out = list(gramcounts.weighed([gramcounts.WORDS], books)(iter([(words,)])))
    assert sum(map(len, out)) == 100 and max(map(len, out)) <= 11


@pytest.mark.parametrize("cells", [8, 1 << 16])
def test_vocabularies_cut_by_cells_are_the_same(rows, monkeypatch, cells):
    whole = modeling.Block.fit(rows, "_word_grams", "_word", 12, 2, 62)
    monkeypatch.setattr(modeling, "CELLS_FROM", 0)
    monkeypatch.setattr(modeling, "CELLS", cells)
    monkeypatch.setattr(gramcounts, "SLICE", 1 << 12)
    cut = modeling.Block.fit(rows, "_word_grams", "_word", 12, 2, 62)
    assert cut.terms.to_pylist() == whole.terms.to_pylist() and (cut.idf == whole.idf).all() and (cut.group == whole.group).all()
    if cells > 8:  # rare pairs are not even counted
        passing = modeling._passing(rows, "_word_grams", 12, 2)
        assert modeling._totals(rows, "_word_grams", passing).count() < modeling._totals(rows, "_word_grams").count()


def test_character_counts_are_those_of_exploded_arrays(rows):
    plain = similarity.term_rows(rows, ngrams.char_ngrams(F.col("_text"))).groupBy("term").agg(
        F.sum("cnt").cast("long").alias("cnt"), F.count("*").alias("df"))
    counted = modeling.gram_counts(rows, F.col("_char_words"), gramcounts.CHARS)
    assert counted.schema.names == plain.schema.names and sorted(counted.collect()) == sorted(plain.collect())
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_history_of_a_fit_stands_in_files():
    path = solver.Descent(np.zeros(3))
    for i in range(4):
        path.told(1.0 / (i + 1), np.array([1.0, 0.5, -0.2]) / (i + 1), 1e-9)
    assert path.pairs and all(isinstance(a, np.memmap) for pair in path.pairs for a in pair)
    np.testing.assert_allclose(solver._filed(np.array([1.0, -2.5])), [1.0, -2.5])


def test_folds_are_scored_one_after_the_other(rows, monkeypatch):
    """The rows of a fold are written before the next fold's fit begins."""
    done, trained, written = [], modeling.train_scorer, modeling.materialize
    monkeypatch.setattr(modeling, "train_scorer", lambda *a, **b: (done.append("fit"), trained(*a, **b))[1])
    monkeypatch.setattr(modeling, "materialize", lambda df, name, **b: (name == "held-out" and done.append(name), written(df, name, **b))[1])
    folds = rows.filter("review_id < 60").select("review_id", "review_text", "biz_name", "biz_cats", "biz_desc", *[F.col("label").alias(c) for c in modeling.LABELS], (F.col("review_id") % 2).alias("fold"))
    modeling.group_cv(folds, 2, max_iter=3)
    assert done == ["fit", "held-out"] * 2


@pytest.mark.parametrize("width", [1, 3, 6, 8])
def test_postings_take_as_few_bytes_as_they_need(width):
    values = np.random.default_rng(width).integers(0, 1 << (8 * width - 1), 50, dtype=np.uint64)
    values[0] = 1 << (8 * width - 1)
    cell = counting.small(values)
    assert len(cell) == 1 + 50 * width and (counting.whole(pa.scalar(cell, pa.binary())) == values).all()
    assert not len(counting.whole(pa.scalar(counting.small(values[:0]), pa.binary())))


def test_postings_name_a_term_once():
    ids = np.repeat(np.array([3, 1 << 40, 5 << 60], np.uint64), [4, 1, 3]).view(np.int64)
    batch = counting._postings(pa.schema([(n, {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary()}[k]) for n, k in counting.POSTINGS.items()]),
                               7, 1, ids, np.arange(8), np.ones(8, np.int64), np.array([0, 2.0, 0, 0, 0, 0, 0, 1.0]))
    assert sum(len(batch[c][0].as_py()) for c in ("ids", "times", "rows", "cnt", "at")) < 8 * 8
    sums = counting.weighed_postings(9)(pa.Table.from_batches([batch]), pa.table({"ids": pa.array([], pa.binary()), "df": pa.array([], pa.binary())}))
    once = (np.log(10 / 2) + 1) ** 2
    np.testing.assert_allclose(np.frombuffer(sums["norm"][0].as_py()), np.full(8, once))
    assert np.frombuffer(sums["sharing"][0].as_py(), "<i4").tolist() == [1, 7]
    np.testing.assert_allclose(np.frombuffer(sums["shared"][0].as_py()), [2 * once, once])
