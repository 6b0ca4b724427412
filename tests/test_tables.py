import gzip
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, ensemble, evaluate, metrics, sampling, thresholds
from plumbline.operators.lookup import lookup_join
from plumbline.plans.jobs import ingest_job
from plumbline.schemas import LABELS, REVIEW_SCHEMA, TASKS
from plumbline.sources import readers, sinks


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'review_id,biz_name,biz_cats,biz_desc,review_text,stars\n'
        '1,"A, ""B""",cats,,"two\nlines",4.7\n2,\t x ,,d,plain,x\n3,n,c,d,t,\n')
    rows = {r["review_id"]: r for r in readers.scan_reviews(spark, str(path), multi_line=True).collect()}
    assert rows["1"]["biz_name"] == 'A, "B"' and rows["1"]["review_text"] == "two\nlines"
    assert rows["2"]["biz_name"] == "x" and rows["2"]["biz_cats"] == ""
    assert [rows[i]["stars"] for i in "123"] == [4, 0, 0]


def test_ingest_odd_lines(spark, tmp_path):
    reviews = [
        {"gmap_id": "g1", "user_id": "u", "rating": 5, "text": "A\u200bB\n c", "time": 1700000000000},
        {"gmapId": "g2", "uid": "v", "text": None, "timestamp": "x"},
        {"gmap_id": "", "gmapid": "g1", "rating": 0, "text": "t"},
        {"text": "no business"},
    ]
    businesses = [
        {"gmap_id": "g1", "name": "old"},
        {"gmapid": "g1", "title": "new", "category": ["a", "b"], "latitude": 0, "lat": 1.5},
        {"gmap_id": "g2", "name": "two", "category": "plain", "province": "ON"},
    ]
    raw, biz = tmp_path / "r.json.gz", tmp_path / "b.json"
    with gzip.open(raw, "wt", encoding="utf-8") as f:
        f.write("\n".join([json.dumps(r) for r in reviews] + ["", '{"gmap_id": "g1", "text":', "}"]))
    biz.write_text("\n".join(json.dumps(b) for b in businesses))
    rows = ingest_job(spark, str(raw), str(biz)).orderBy("business_id", "stars").collect()
    assert [(r["business_id"], r["biz_name"], r["review_text"], r["stars"]) for r in rows] == [
        ("g1", "new", "t", 0), ("g1", "new", "AB c", 5), ("g2", "two", "", 0)]
    assert rows[0]["biz_cats"] == "a, b" and rows[2]["biz_cats"] == "plain"
    assert rows[0]["lat"] == pytest.approx(1.5) and rows[2]["state"] == "ON"
    tagged = ingest_job(spark, str(raw), str(biz), state="CA").select("state").distinct().collect()
    assert [r[0] for r in tagged] == ["CA"]


def test_overwrite_does_not_repeat(spark, tmp_path):
    df = clean.ensure_columns(spark.createDataFrame([("1", "CA"), ("2", None)], "review_id string, state string"))
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.schema(REVIEW_SCHEMA).parquet(str(tmp_path / "t")).count() == 2


def test_hot_key_lookup_equals_plain_join(spark):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    dim = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    split = lookup_join(facts, dim, "k", broadcast_rows=0, max_hot_keys=10)
    plain = facts.join(dim, "k", "left")
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_dedup_of_one_dominant_text(spark):
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("review_id"), F.lit("b").alias("business_id"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("same").alias("review_text"))
    out = clean.dedup_reviews(df)
    assert out.count() == 667 + 1
    assert out.filter("review_text = 'same'").first()["review_id"] == "1"


def test_upload_without_keys(spark):
    df = spark.createDataFrame([("hi", " None "), ("nan", "x")], "review_text string, biz_name string")
    out = clean.normalize_upload(df).collect()
    assert {(r["review_text"], r["biz_name"]) for r in out} == {("hi", ""), ("", "x")}
    assert len({r["review_id"] for r in out}) == 2


@pytest.mark.parametrize("form", ["label_{}", "{}", "pred_label_{}", "pred_{}", "y_pred_{}", "my_{}", "{}_pred", "label_{}_pred", "my_{}_pred"])
def test_resolution_never_picks_truth(spark, form):
    truth = spark.createDataFrame([("1", 1, 0, 0)], ["review_id", *LABELS])
    preds = spark.createDataFrame([("1", 0, 1, 0)], ["review_id", *[form.format(t) for t in TASKS]])
    joined, pairs = evaluate.align_predictions(truth, preds)
    counts = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.confusion_counts(joined, pairs).collect()}
    assert counts["label_ads"] == (0, 0, 1) and counts["label_irrelevant"] == (0, 1, 0)


def test_duplicate_keys_are_reported(spark):
    with pytest.raises(ValueError, match="not unique"):
        evaluate.assert_unique(spark.createDataFrame([("1",), ("1",)], "review_id string"))


def test_tie_takes_smallest_threshold(spark):
    oof = spark.createDataFrame([("irrelevant", 1, 0.9), ("irrelevant", 0, 0.1)], "label string, y int, p double")
    rows = {r["label"]: r["thr"] for r in thresholds.tune_oof(oof).collect()}
    assert rows == {"ads": 0.5, "irrelevant": 0.2, "rant_no_visit": 0.5}


def test_modes_are_nested(spark):
    rows = [(str(i), i % 2, (i // 2) % 2, (i // 4) % 2, (i % 11) / 10.0) for i in range(88)]
    df = spark.createDataFrame(rows, ["review_id", *TASKS, "irrelevant_p"]).withColumns(
        {"ads_p": F.lit(0.0), "rant_no_visit_p": F.lit(0.0)})
    flagged = {m: {r[0] for r in ensemble.combine(df, m).filter("label_irrelevant = 1").select("review_id").collect()}
               for m in ("precision", "balanced", "recall")}
    assert flagged["precision"] < flagged["balanced"] < flagged["recall"]


def test_group_folds(spark):
    sizes = {"a": 50, "b": 30, "c": 20, "d": 10, "e": 9, "f": 1}
    df = spark.createDataFrame(
        [(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)], "review_id string, business_id string")
    out = sampling.group_kfold(df, 3)
    folds = {r["business_id"]: r["fold"] for r in out.distinct().collect()}
    assert folds == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1, "f": 2}
    assert out.count() == sum(sizes.values())


def test_light_groups_fill_the_room(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LIGHT_GROUP_PARTS", 2)
    df = spark.range(9000).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("business_id"))
    out = sampling.group_kfold(df, 3)
    sizes = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert sizes[0] == 3000 and abs(sizes[1] - sizes[2]) < 400
    assert out.groupBy("business_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_shards_match_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review_id,stars\n1,5\n")
    (tmp_path / "b.csv").write_text("stars,review_id\n4,2\n")
    (tmp_path / "c.csv").write_text("review_id\n3\n")
    for paths in (str(tmp_path), str(tmp_path / "*.csv"), [str(tmp_path / f"{n}.csv") for n in "abc"]):
        rows = {r["review_id"]: r["stars"] for r in readers.union_shards(spark, paths).collect()}
        assert rows == {"1": "5", "2": "4", "3": None}


def test_uploads_get_a_key_per_row(spark):
    rows = [("Great place!", "A"), ("Great place!", "B"), ("Great place!", "A"), ("Great place!", "A")]
    out = clean.normalize_upload(spark.createDataFrame(rows, "review_text string, biz_name string").repartition(3))
    assert out.select("review_id").distinct().count() == 4
    again = clean.normalize_upload(spark.createDataFrame(rows[::-1], "review_text string, biz_name string"))
    assert out.select("review_id").exceptAll(again.select("review_id")).count() == 0


def test_dedup_keeps_cells_without_a_key(spark):
    rows = [(None, "b", "t", 5), (None, "b", "t", 4), ("k", "b", "u", 3), (None, "b", "u", 1)]
    out = clean.dedup_reviews(spark.createDataFrame(rows, "review_id string, business_id string, review_text string, stars int"))
    assert {(r["review_text"], r["review_id"], r["stars"]) for r in out.collect()} == {("t", None, 4), ("u", "k", 3)}


def test_scores_fill_in_and_must_be_unique(spark):
    reviews = spark.createDataFrame([("1",), ("2",)], "review_id string")
    scores = spark.createDataFrame([("1", 0.7)], "review_id string, irrelevant_p double")
    found = {r["review_id"]: (r["ads_p"], r["irrelevant_p"]) for r in ensemble.attach_scores(reviews, scores).collect()}
    assert found == {"1": (0.0, 0.7), "2": (0.0, 0.0)}
    with pytest.raises(ValueError, match="not unique"):
        ensemble.attach_scores(reviews, scores.unionByName(scores))


def test_tasks_without_scores_keep_one_half(spark):
    rows = [("1", 0, "irrelevant", 1, 0.9), ("2", 0, "irrelevant", 0, 0.1)]
    oof = spark.createDataFrame(rows, "review_id string, fold int, label string, y int, p double")
    found = {r["label"]: r["thr"] for r in thresholds.tune_oof(oof).collect()}
    assert found["ads"] == found["rant_no_visit"] == 0.5 and set(found) == set(TASKS)


def test_wide_lookup_rows_are_not_broadcast(spark):
    from plumbline.operators.lookup import fits

    dim = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("biz_desc"))
    assert fits(dim) and not fits(dim, size=5_000) and not fits(dim, rows=5)


def test_a_split_record_is_an_error(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('review_id,review_text,stars\na,"one line",3\nb,"two\nlines",4\n')
    whole = readers.scan_typed(spark, str(path), multi_line=True)
    assert sorted(r.review_text for r in whole.collect()) == ["one line", "two\nlines"]
    for column in ("review_id", "stars"):  # also if only some columns are read
        with pytest.raises(Exception, match="broken CSV record"):
            readers.scan_typed(spark, str(path)).select(column).collect()
    path.write_text('review_id,review_text,stars\na,"one, line",3\n')
    assert readers.scan_typed(spark, str(path)).count() == 1
