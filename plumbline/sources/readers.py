"""Readers.  Types are declared, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import coerce_stars
from plumbline.functions.text import blank, strip
from plumbline.operators.clean import ensure_columns
from plumbline.schemas import LABELED_SCHEMA, TEXT_COLUMNS

BROKEN = "_broken_record"


def read_csv_cells(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False
) -> DataFrame:
    """All columns of the header as strings.

    Files must have one header; ``union_shards`` reads files with different ones.  ``multi_line`` also
    reads line breaks inside quotes, at the price of one task per file; without it large files are split, and a
    record that does not have a cell for every column, as a quoted line break leaves it, is an error.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    cells = reader.option("multiLine", multi_line).csv(paths)
    if multi_line or not cells.columns:
        return cells
    fields = [T.StructField(c, T.StringType()) for c in (*cells.columns, BROKEN)]
    checked = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", BROKEN)
    checked = checked.option("columnPruning", False).csv(paths)
    # The first cell is named because Spark refuses queries that touch nothing but the broken record.
    first = F.coalesce(F.substring(F.col(f"`{cells.columns[0]}`"), 1, 50), F.lit(""))
    message = F.concat_ws(" ", F.lit("broken CSV record, try multi_line=True:"), first, F.lit("in"), F.substring(BROKEN, 1, 200))
    whole = F.when(F.col(BROKEN).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.filter(whole).drop(BROKEN)


def scan_reviews(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False
) -> DataFrame:
    """Review CSV with its text columns filled and trimmed and its stars made whole numbers."""
    df = read_csv_cells(spark, paths, multi_line)
    cleaned = {c: strip(blank(F.col(c))) for c in TEXT_COLUMNS}
    if "stars" in df.columns:
        cleaned["stars"] = coerce_stars(F.col("stars"))
    return df.withColumns(cleaned)


def scan_typed(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = LABELED_SCHEMA,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with declared types: a cell that does not fit is null, a missing column is all null."""
    return ensure_columns(read_csv_cells(spark, paths, multi_line), schema)


def scan_jsonl(
    spark: SparkSession,
    paths: str | Sequence[str],
    aliases: Mapping[str, Sequence[str]],
    partitions: int | None = None,
) -> DataFrame:
    """JSON lines, plain or gzipped: ``line_order`` and an array ``<field>_raw`` of alias values.

    Values stay strings, so a field may hold a list in one line and plain text in the next.  Blank
    and malformed lines yield no row.  A gzip file is one task; ``partitions`` spreads its rows.
    """
    names = [n for group in aliases.values() for n in group]
    lines = spark.read.text(paths).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_order"),
    )
    if partitions:
        lines = lines.repartition(partitions)
    # json_tuple tells apart aliases that differ in letter case only.
    cells = [f"cell_{i}" for i in range(len(names))]
    parsed = lines.filter(F.try_parse_json("value").isNotNull()).select(
        "line_order", F.json_tuple("value", *names).alias(*cells)
    )
    taken, columns = 0, []
    for target, group in aliases.items():
        group_cells = cells[taken : taken + len(group)]
        columns.append(F.array(*group_cells).alias(f"{target}_raw"))
        taken += len(group)
    return parsed.select("line_order", *columns)


def union_shards(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False
) -> DataFrame:
    """All shards one below the other, matched by column name; ``paths`` may hold patterns and folders.

    One job finds the first line of every file; then there is one scan per distinct header, and a
    column that a header lacks is null.
    """
    if not paths:
        raise ValueError("no shards given")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        "value",
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"),
    )
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    by_header = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups = by_header.orderBy("header").collect()  # names of files, not what they hold
    frames = [read_csv_cells(spark, row["files"], multi_line) for row in groups]
    if not frames:
        raise ValueError("no shard holds a line")
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def scan_pruned(
    df: DataFrame,
    labels: Sequence[str],
    text: Sequence[str] = ("review_text", "biz_name", "biz_cats"),
    group: str = "business_id",
) -> DataFrame:
    """Only what training needs.  A missing label is an error, before anything is read."""
    missing = [c for c in labels if c not in df.columns]
    if missing:
        raise ValueError(f"missing label columns: {missing}")
    return df.select(*text, group, *labels)
