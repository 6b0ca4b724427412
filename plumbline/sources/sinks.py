"""Writers, and readers of what they wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.schemas import TASKS

OOF_SCHEMA = "review_id string, label string, y int, p double, fold int"


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("state",), fmt: str = "parquet"
) -> None:
    """Replace the table at ``path``.

    The rebalance hint merges small partition values and splits large ones, so one large state is
    not one task and a rare one not a thousand files.
    """
    writer = df.hint("rebalance", *partition_by) if partition_by else df
    out = writer.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        out = out.option("header", True).option("escape", '"')
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.save(path)


def write_oof(df: DataFrame, path: str) -> None:
    """Out-of-fold scores ``(review_id, fold, label, y, p)``, one folder per fold."""
    df.select("review_id", "fold", "label", "y", "p").write.mode("overwrite").partitionBy(
        "fold"
    ).parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    """All folds stacked: the folder is the table."""
    return spark.read.schema(OOF_SCHEMA).parquet(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """Rows ``(label, thr)``."""
    thresholds.select("label", "thr").coalesce(1).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, thr double").json(path)


def thresholds_table(spark: SparkSession, found: DataFrame | Mapping[str, float]) -> DataFrame:
    """One row per task; a task without a threshold gets 0.5."""
    tasks = spark.createDataFrame([(t,) for t in TASKS], "label string")
    if not isinstance(found, DataFrame):
        found = spark.createDataFrame(list(found.items()), "label string, thr double")
    known = found.filter(F.col("label").isin(*TASKS)).groupBy("label").agg(F.max("thr").alias("thr"))
    return tasks.join(known, "label", "left").withColumn("thr", F.coalesce("thr", F.lit(0.5)))


def threshold_values(found: DataFrame | Mapping[str, float] | None) -> dict[str, float]:
    """The three thresholds as plain numbers, so that decisions compile to constants."""
    values = dict.fromkeys(TASKS, 0.5)
    if isinstance(found, DataFrame):
        rows = thresholds_table(found.sparkSession, found).collect()  # three rows
        return {r["label"]: r["thr"] for r in rows}
    values.update({t: float(v) for t, v in (found or {}).items() if t in TASKS})
    return values
