"""One-review scoring as a stream.

Each review is labeled by itself, with similarity fitted on the review and its business, so no
state and no watermark are needed and late rows are not special.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.operators.lookup import lookup_join
from plumbline.operators.rules import render_reasons, rules_label
from plumbline.policy import DEFAULT_POLICY, Policy
from plumbline.session import workspace

BUSINESS_COLUMNS = ("biz_name", "biz_cats", "biz_desc")


def read_reviews(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def label_stream(
    reviews: DataFrame,
    businesses: DataFrame | None = None,
    policy: Policy = DEFAULT_POLICY,
    keep: tuple[str, ...] = ("review_id", "business_id"),
) -> DataFrame:
    """Labels, score and reasons of each arriving review.

    ``businesses`` holds one row per ``business_id`` and is joined as a static table; leave it out
    if the business fields come with the review.
    """
    if businesses is not None:
        facts = businesses.select("business_id", *BUSINESS_COLUMNS)
        reviews = reviews.join(facts, "business_id", "left")
    filled = reviews.withColumns({c: F.coalesce(c, F.lit("")) for c in BUSINESS_COLUMNS})
    return render_reasons(rules_label(filled, policy, scope="pair", keep=keep))


def write_labels(labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table; the checkpoint makes each review count exactly once."""
    writer = labels.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def label_batches(
    reviews: DataFrame,
    businesses: DataFrame,
    path: str,
    checkpoint: str,
    policy: Policy = DEFAULT_POLICY,
    keep: tuple[str, ...] = ("review_id", "business_id"),
) -> StreamingQuery:
    """Label arriving reviews batch by batch, with a lookup that splits hot businesses.

    Each batch fills one folder ``batch=<id>`` of the table and overwrites it, so a batch that is run again after a
    failure leaves the same rows once.
    """
    facts = businesses.select("business_id", *BUSINESS_COLUMNS)

    def label(batch: DataFrame, number: int) -> None:
        with workspace(batch.sparkSession):
            joined = lookup_join(batch, facts, "business_id")
            labels = label_stream(joined, policy=policy, keep=keep)
            labels.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = reviews.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
