import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import features, metrics, modeling, rules
from plumbline.schemas import SCORES
from plumbline.session import shared_dir, workspace


@pytest.fixture(scope="module")
def labeled(spark):
    rows = []
    for i in range(60):
        ad, off = i % 2, (i // 2) % 2
        text = ("buy cheap promo today" if ad else "lovely warm dinner") + (" my laptop broke" if off else "")
        rows.append((str(i), f"b{i % 6}", text + f" n{i}", "Shop", "Food", "", ad, off, 0))
    names = ("review_id business_id review_text biz_name biz_cats biz_desc label_ads "
             "label_irrelevant label_rant_no_visit")
    return spark.createDataFrame(rows, names.split())


def test_scorer_learns_and_reloads(spark, labeled, tmp_path):
    scorer = modeling.train_scorer(labeled, labels=("label_ads", "label_irrelevant"), max_iter=50)
    scored = scorer.score(labeled)
    by = {r["label_ads"]: r["p"] for r in scored.groupBy("label_ads").agg(F.avg("ads_p").alias("p")).collect()}
    assert by[1] > 0.7 > 0.3 > by[0]
    assert scored.agg(F.max("rant_no_visit_p")).first()[0] == 0.0
    scorer.save(str(tmp_path))
    again = modeling.ReviewScorer.load(spark, str(tmp_path)).score(labeled)
    assert again.select("review_id", *SCORES).exceptAll(scored.select("review_id", *SCORES)).count() == 0


def test_grouped_cv(labeled):
    folds = labeled.withColumn("fold", (F.substring("business_id", 2, 1) >= "3").cast("int"))
    held_out, macro = modeling.group_cv(folds, 2, max_iter=30)
    assert held_out.count() == 60
    assert macro.first()["recall"] > 0.5


def plain_fit(x, y, c=modeling.INVERSE_REGULARIZATION):
    """Newton's method on the class-balanced objective."""
    n = len(y)
    cost = np.where(y > 0, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1)))
    z = np.hstack([x, np.ones((n, 1))])
    ridge = np.diag([*[1 / c] * x.shape[1], 0.0])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (cost * (p - y)) + ridge @ w)
    return 1 / (1 + np.exp(-z @ w))


@pytest.mark.parametrize("with_meta", [False, True])
def test_fits_reach_the_optimum_with_and_without_collapsed_columns(labeled, with_meta):
    labels = ("label_ads", "label_irrelevant", "label_rant_no_visit")
    options = dict(labels=labels, min_df=2, with_meta=with_meta, tol=1e-8)
    scorer = modeling.train_scorer(labeled, **options)
    plain = modeling.train_scorer(labeled, collapse=False, **options)
    source = modeling.add_grams(modeling.add_keep(labeled))
    rows = scorer.vectorize(source).select(*labels, vector_to_array(scorer.features).alias("x"), "review_id")
    found = rows.toPandas().sort_values("review_id")
    both = [s.score(labeled).toPandas().sort_values("review_id") for s in (scorer, plain)]
    x = np.stack(found["x"])
    assert len({x[:, j].tobytes() for j in range(x.shape[1])}) < x.shape[1] / 2  # there is something to collapse
    for label, p in zip(labels, SCORES):
        truth = plain_fit(x, found[label].to_numpy(float)) if label != "label_rant_no_visit" else np.zeros(len(x))
        for scored in both:
            assert np.abs(scored[p].to_numpy() - truth).max() < 1e-4


def test_fold_reports_count_held_out_decisions(labeled):
    """Each fold's report counts the decisions on its held-out rows."""
    folds = labeled.withColumn("fold", (F.substring("business_id", 2, 1) >= "3").cast("int"))
    decided, _ = modeling.group_cv(folds, 2, labels=("label_ads", "label_irrelevant"))
    pairs = [metrics.Pair(c, c, f"{c}_hat") for c in ("label_ads", "label_irrelevant")]
    found = {(r.fold, r.label): (r.precision, r.recall, r.support) for r in metrics.label_report(decided, pairs, ["fold"]).collect()}
    rows = decided.toPandas()
    for (fold, label), (precision, recall, support) in found.items():
        part = rows[rows["fold"] == fold]
        hit, truth = part[f"{label}_hat"] == 1, part[label] == 1
        assert support == truth.sum() and precision == pytest.approx((hit & truth).sum() / max(hit.sum(), 1))
        assert recall == pytest.approx((hit & truth).sum() / truth.sum())
        assert recall > 0.5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_stay_in_the_jvm(labeled):
    for df in (features.featurize_metadata(labeled), features.add_meta_features(labeled)):
        text = plan(df)
        assert "Python" not in text and "Exchange" not in text


def test_pair_labels_need_no_shuffle(labeled):
    assert "Exchange" not in plan(rules.rules_label(labeled, scope="pair"))


def test_pruned_scan(spark, labeled, tmp_path):
    labeled.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    flags = rules.normalize_for_rules(stored).select(rules.ads_hit(F.col("norm_text")))
    assert "ReadSchema: struct<review_text:string>" in plan(flags)


def test_a_job_leaves_nothing_but_its_output(spark, labeled, tmp_path):
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with workspace(spark):
        rules.rules_label(labeled).write.parquet(str(tmp_path / "out"))
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_two_reviews_under_one_key_are_two_reviews(labeled):
    """The second half repeats the keys of the first; every review keeps its own labels and score."""
    keep = ("review_id", "review_text")
    whole = {r["review_text"]: tuple(r)[2:] for r in rules.rules_label(labeled, keep=keep).collect()}
    twice = labeled.withColumn("review_id", (F.col("review_id").cast("int") % 30).cast("string"))
    found = rules.rules_label(twice, keep=keep).collect()
    assert len(found) == 60 and {r["review_text"]: tuple(r)[2:] for r in found} == whole
