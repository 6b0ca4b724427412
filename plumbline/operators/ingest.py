"""From raw lines to canonical reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import coerce_stars, first_truthy, join_categories, review_uuid
from plumbline.functions.text import norm_ingest
from plumbline.operators.clean import tag_state
from plumbline.operators.lookup import lookup_join
from plumbline.schemas import BUSINESS_ALIASES, REVIEW_ALIASES, REVIEW_COLUMNS


def _pick(field: str, aliases: dict[str, tuple[str, ...]], zero_is_empty: bool = False) -> Column:
    cells = [F.get(f"{field}_raw", F.lit(i)) for i in range(len(aliases[field]))]
    return first_truthy(*cells, zero_is_empty=zero_is_empty)


def business_table(raw: DataFrame) -> DataFrame:
    """One row per business; of several lines with one id the last counts.

    Expects the output of ``scan_jsonl`` with ``BUSINESS_ALIASES``.
    """
    text = ("biz_name", "biz_desc", "state", "city", "price")
    fields = {c: F.coalesce(_pick(c, BUSINESS_ALIASES), F.lit("")) for c in text}
    fields["biz_cats"] = join_categories(_pick("biz_cats", BUSINESS_ALIASES))
    for c in ("lat", "lon"):
        fields[c] = _pick(c, BUSINESS_ALIASES, zero_is_empty=True).try_cast("float")
    rows = raw.select(
        _pick("business_id", BUSINESS_ALIASES).alias("business_id"),
        "line_order",
        F.struct(*[v.alias(k) for k, v in fields.items()]).alias("biz"),
    ).filter("business_id is not null")
    last = rows.groupBy("business_id").agg(F.max_by("biz", "line_order").alias("biz"))
    return last.select("business_id", "biz.*")


def review_rows(raw: DataFrame) -> DataFrame:
    """Reviews with key, text, stars and time.

    Expects the output of ``scan_jsonl`` with ``REVIEW_ALIASES``.
    """
    stamp = _pick("time", REVIEW_ALIASES, zero_is_empty=True)
    time_ms = F.coalesce(stamp.try_cast("bigint"), stamp.try_cast("double").try_cast("bigint"))
    picked = raw.select(
        _pick("business_id", REVIEW_ALIASES).alias("business_id"),
        _pick("user_id", REVIEW_ALIASES).alias("user_id"),
        norm_ingest(F.get("text_raw", F.lit(0))).alias("review_text"),
        coerce_stars(F.get("rating_raw", F.lit(0))).alias("stars"),
        time_ms.alias("time_ms"),
    ).filter("business_id is not null")
    key = review_uuid(F.col("user_id"), F.col("business_id"), F.col("time_ms"))
    return picked.select(key.alias("review_id"), *[c for c in picked.columns if c != "user_id"])


def enrich_business(reviews: DataFrame, businesses: DataFrame, state: str = "") -> DataFrame:
    """Reviews with the facts of their business; unknown businesses give empty text."""
    joined = lookup_join(reviews, businesses, "business_id")
    tagged = tag_state(joined, state)
    names = {c: norm_ingest(F.col(c)) for c in ("biz_name", "biz_cats", "biz_desc")}
    filled = tagged.withColumns(names).na.fill("", ["state", "city", "price", "review_text"])
    return filled.select(*REVIEW_COLUMNS)
