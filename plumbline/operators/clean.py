"""Column cleaning, label checks and deduplication."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import coerce_stars, content_review_id, hash_business_id
from plumbline.functions.text import blank, blank_null_words, norm_clean
from plumbline.schemas import REVIEW_SCHEMA, TEXT_COLUMNS
from plumbline.session import materialize


def keep_english(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows in English; an unknown language is kept."""
    return df.filter(F.coalesce(F.col(lang), F.lit("en")) == "en")


def dedup_reviews(
    df: DataFrame,
    subset: Sequence[str] = ("business_id", "review_text"),
    order: str = "review_id",
) -> DataFrame:
    """One row per ``subset``: the one with the smallest ``order``; a null one counts as largest.

    An aggregate, not a window: copies collapse on the map side, so a text that is a third of the
    table never meets in one task.
    """
    rest = [c for c in df.columns if c not in subset]
    # A null key comes last, and the other cells settle ties; min_by would return null for a null order.
    first = [F.col(order).isNull(), F.col(order), *[F.col(c) for c in rest if c != order]]
    kept = F.min_by(F.struct(*rest), F.struct(*first)).alias("kept")
    return df.groupBy(*subset).agg(kept).select(*subset, "kept.*").select(*df.columns)


def synthesize_id(df: DataFrame) -> DataFrame:
    """Fill a missing ``review_id`` with a digest of all other columns and an occurrence number.

    Rows that are equal in every column are numbered 1, 2, ... so each gets a key of its own.  They are
    numbered within each task's rows, and a small table holds how many come before, so a row that is a third
    of the upload never meets in one task.  The upload is written once for that.
    """
    parts = [c for c in df.columns if c != "review_id"]
    given = df if "review_id" in df.columns else df.withColumn("review_id", F.lit(None).cast("string"))
    content = content_review_id(*[F.col(c) for c in parts])
    stored = materialize(given.withColumns({"_content": content, "_part": F.spark_partition_id()}), "upload")
    inside = F.row_number().over(Window.partitionBy("_content", "_part").orderBy("_content"))
    sizes = stored.groupBy("_content", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_content", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = stored.withColumn("_inside", inside).join(before, ["_content", "_part"])
    made = content_review_id(*[F.col(c) for c in parts], F.col("_before") + F.col("_inside"))
    return numbered.withColumn("review_id", F.coalesce("review_id", made)).select(*given.columns)


def assert_unique(df: DataFrame, key: str = "review_id") -> DataFrame:
    """Fail if a key occurs twice; joins on it would multiply rows."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique, for example {twice[0][key]!r}")
    return df


def map_source_schema(df: DataFrame) -> DataFrame:
    """Restaurant source columns to canonical columns; author and category ride along."""
    def source(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    return df.select(
        content_review_id(*[source(c) for c in ("business_name", "author_name", "text", "rating")])
        .alias("review_id"),
        hash_business_id(F.col("business_name")).alias("business_id"),
        norm_clean(F.col("business_name")).alias("biz_name"),
        F.lit("Restaurant").alias("biz_cats"),
        F.lit("").alias("biz_desc"),
        norm_clean(F.col("text")).alias("review_text"),
        coerce_stars(F.col("rating"), clip=True).alias("stars"),
        source("author_name").alias("author_name"),
        source("rating_category").alias("rating_category"),
    )


def ensure_columns(df: DataFrame, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    """The columns of ``schema`` first, cast or added as nulls; other columns stay behind them."""
    typed = []
    for f in schema.fields:
        if f.name not in df.columns:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        cell = F.col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            # '4.0' is a whole number too: numbers pass through double.
            whole = F.floor(cell.try_cast("double")).try_cast(f.dataType)
            cell = F.coalesce(cell.try_cast(f.dataType), whole)
        else:
            cell = cell.try_cast(f.dataType)
        typed.append(cell.alias(f.name))
    known = set(schema.fieldNames())
    return df.select(*typed, *[c for c in df.columns if c not in known])


def normalize_upload(df: DataFrame) -> DataFrame:
    """Minimal guarantees for a table from outside: text present, keys present."""
    texts = {
        c: blank_null_words(F.col(c).cast("string")) if c in df.columns else F.lit("")
        for c in TEXT_COLUMNS
    }
    out = df.withColumns(texts)
    if "business_id" not in out.columns:
        out = out.withColumn("business_id", F.lit(""))
    return synthesize_id(out)


def text_template(short: bool = False) -> Column:
    """Model input: review, separator, business.  The short form leaves the description out."""
    review, name, cats, desc = (blank(F.col(c)) for c in TEXT_COLUMNS)
    if short:
        return F.concat(review, F.lit(" [SEP] "), name, F.lit(" | "), cats)
    return F.concat(review, F.lit(" [SEP] "), name, F.lit(" "), cats, F.lit(" "), desc)


def nonempty_text(df: DataFrame, text: str = "review_text") -> DataFrame:
    return df.filter(F.length(text) > 0)


def _inconsistent() -> Column:
    return (F.col("label_relevant") + F.col("label_irrelevant")).isin(0, 2)


def check_labels(df: DataFrame) -> DataFrame:
    """Rows whose relevant and irrelevant labels agree, which they never should."""
    return df.filter(_inconsistent())


def repair_labels(df: DataFrame) -> DataFrame:
    fixed = F.when(_inconsistent(), F.lit(1) - F.col("label_irrelevant"))
    return df.withColumn("label_relevant", fixed.otherwise(F.col("label_relevant")))


def fill_null_text(df: DataFrame, columns: Iterable[str] = TEXT_COLUMNS) -> DataFrame:
    return df.na.fill("", [c for c in columns if c in df.columns])


def tag_state(df: DataFrame, tag: str) -> DataFrame:
    """A batch-wide state tag overrules the state of the business."""
    return df.withColumn("state", F.coalesce(F.nullif(F.lit(tag), F.lit("")), F.col("state")))


def cap_rows(df: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    """The first ``n`` rows by key; 0 keeps all."""
    return df.orderBy(key).limit(n) if n else df


# Names a report accepts for each context column, first choice first.
CONTEXT_GROUPS = (
    ("review_id",),
    ("business_id", "place_id", "business_name"),
    ("biz_name", "business_name", "name"),
    ("biz_cats", "rating_category", "category", "categories"),
    ("review_text", "text", "comment", "content", "review"),
)


def pick_context(columns: Sequence[str]) -> list[str]:
    """The first name of each group that is present."""
    found = (next((c for c in group if c in columns), None) for group in CONTEXT_GROUPS)
    return list(dict.fromkeys(c for c in found if c))
