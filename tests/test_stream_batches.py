"""Batch-wise stream labels: a hot business, and a batch that is run twice."""

from plumbline.streaming import label_stream as stream


def test_a_replayed_batch_leaves_its_rows_once(spark, tmp_path):
    rows = [(str(i), "hot" if i % 3 == 0 else f"b{i}", "call now for a warm dinner" if i % 2 else "lovely") for i in range(60)]
    arriving = spark.createDataFrame(rows, "review_id string, business_id string, review_text string")
    arriving.write.parquet(str(tmp_path / "in"))
    facts = [(b, f"Shop {b}", "Food", "warm dinner") for b in {r[1] for r in rows} - {"b1"}]
    businesses = spark.createDataFrame(facts, "business_id string, biz_name string, biz_cats string, biz_desc string")
    batch = stream.label_stream(arriving, businesses)
    expected = sorted(map(tuple, batch.collect()))
    for run in range(2):  # a new checkpoint replays batch 0 from the start
        reviews = stream.read_reviews(spark, str(tmp_path / "in"), arriving.schema)
        stream.label_batches(reviews, businesses, str(tmp_path / "out"), str(tmp_path / f"checkpoint{run}")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
        assert sorted(map(tuple, found.collect())) == expected
    assert len(expected) == 60
