"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import ann, brown, decontaminate, jaccard, langid, lines, mixing, records, secrets, toxicity
from plumbline.llm.queries import tokenizer_path

BENCH = "item_id long, text string"
LABELS = "doc_id long, toxic int"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(10, "sat on the mat"), (11, None), (12, ""), (None, "some words in it")], BENCH)


def test_contamination(odd, bench, empty):
    found = decontaminate.contamination(odd, bench)
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found.collect()}
    assert found.count() == odd.count()
    assert (1, 14, 4, ("10",)) in got and (3, 0, 0, ()) in got and (4, 0, 0, ()) in got
    assert (None, 11, 4, ()) in got  # an item without id hits but is not listed
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, bench.limit(0)).collect()} == {0}


def test_clean_documents(odd, bench, empty):
    kept = decontaminate.clean_documents(odd, bench)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == rows_of(odd.where("doc_id is null and text is null or doc_id > 2"), "doc_id")
    assert decontaminate.clean_documents(empty, bench).count() == 0


def test_jaccard(odd, empty):
    found = jaccard.jaccard_components(odd)
    assert rows_of(found.where("doc_id < 6"), "doc_id", "n_shingles", "component_id") == [(1, 11, 1), (2, 11, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert found.count() == odd.count() and found.where("doc_id = 7").count() == 2
    assert jaccard.jaccard_components(empty).count() == 0


def test_one_per_group(odd, empty):
    kept = jaccard.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9] and ids.count(None) == 2
    assert jaccard.one_per_group(empty).count() == 0


def test_secrets(odd, empty):
    found = secrets.secret_spans(odd)
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    assert secrets.secret_spans(empty).count() == 0


def test_records(odd, empty):
    found = records.token_records(odd, tokenizer_path())
    got = sorted(found.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:2] == [None, None] and len(got) == odd.count()
    assert [r.doc_id for r in got][2:] == sorted(r.doc_id for r in got[2:])
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    only_end = zlib.crc32((2).to_bytes(4, "little"))
    assert {(r.n_tokens, r.ids_crc32) for r in got if r.doc_id in (3, 4)} == {(1, only_end)}
    assert records.token_records(empty, tokenizer_path()).count() == 0


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (7, 1), (9, 0), (8, 0)], LABELS)
    found = toxicity.toxicity(odd, labels)
    assert found.count() == odd.count()
    assert found.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_mixture(odd, empty):
    found = mixing.mixture(odd)
    assert found.count() == odd.count()
    assert found.where("taken > 2 * size or taken < 0 or target > 2 * source_size + 1e-6").count() == 0
    assert rows_of(found.where("doc_id in (3, 4, 5)"), "size", "taken") == [(0, 0)] * 3
    assert mixing.mixture(empty).count() == 0
    mixed = mixing.mixed_documents(odd)
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert mixed.columns == odd.columns and words == found.agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(empty).count() == 0


def test_lines(odd, empty):
    found = lines.deduplicated_lines(odd)
    got = rows_of(found.where("doc_id < 6"), "doc_id", "text", "n_lines", "n_removed")
    assert got == [(1, "the cat sat on the mat and then it slept there all day long", 1, 0), (2, "", 1, 1), (3, None, 0, 0), (4, "", 1, 0), (5, " \t\n ", 2, 0)]
    assert rows_of(found.where("doc_id = 7"), "n_removed") == [(0,), (0,)]
    assert lines.deduplicated_lines(empty).count() == 0


def test_language(odd, empty):
    found = langid.identified(odd)
    assert found.count() == odd.count()
    assert {r.lang_pred for r in found.where("doc_id in (3, 4, 5, 8)").collect()} == {"und"}
    assert found.where("score < 0 or score > 1").count() == 0
    assert {r.lang_pred for r in langid.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    assert langid.known_language(empty).count() == 0 and langid.identified(empty).count() == 0


def test_class_scores(odd, empty):
    found = brown.class_scores(odd)
    assert found.count() == odd.count() and found.where("score is null or score > 0").count() == 0
    assert rows_of(found.where("doc_id in (3, 4, 5)"), "n_tokens") == [(1,)] * 3
    assert brown.class_scores(empty).count() == 0
    held = odd.where("doc_id = 7").limit(0).unionByName(odd.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"))
    assert held.count() and {r.train_tokens for r in brown.class_scores(held).collect()} == {0}


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, id string, vec string, rep int"
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [1.0, 1.0])]
    vectors += [(8, [0.5, 0.5]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    base = spark.createDataFrame([(*v, "x", "y", 1) for v in vectors], schema)
    found = ann.nearest_neighbours(base, base, k=2)
    got = rows_of(found, "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 0.5), (1, 1, 0, 1.0), (1, 2, 8, 0.5), (8, 1, 0, 0.5), (8, 2, 1, 0.5), (9, 1, 8, -0.5), (9, 2, 0, -1.0)]
    assert ann.nearest_neighbours(base.limit(0), base.limit(0)).count() == 0


def test_neighbours_of_an_id_with_many_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.1, 0.9]), (3, [0.8, 0.2]), (3, [0.8, 0.2])]
    vectors += [(int(i), [float(x) for x in rng.integers(-3, 4, 2)]) for i in rng.integers(1, 12, 60)]
    vectors += [(7, [float(i), float(-i)]) for i in range(1, 40)]
    base = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = sorted({(i, tuple(v)) for i, v in vectors if any(v)})
    expected = []
    for i, v in rows:
        others = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for j, w in rows if (j, w) != (i, v))
        expected += [(i, rank, j, -score) for rank, (score, j) in enumerate(others[:5], 1)]
    got = ann.nearest_neighbours(base, base, k=5)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


def test_stages(spark, odd, empty, tmp_path, bench):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (out.count() > 0) == (start is odd)

