"""Column names and types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_COLUMNS = ("review_text", "biz_name", "biz_cats", "biz_desc")

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("business_id", T.StringType()),
        T.StructField("biz_name", T.StringType()),
        T.StructField("biz_cats", T.StringType()),
        T.StructField("biz_desc", T.StringType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("stars", T.IntegerType()),
        T.StructField("time_ms", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("lat", T.FloatType()),
        T.StructField("lon", T.FloatType()),
        T.StructField("price", T.StringType()),
    ]
)

REVIEW_COLUMNS = tuple(REVIEW_SCHEMA.fieldNames())

LABELED_SCHEMA = T.StructType(
    REVIEW_SCHEMA.fields
    + [
        T.StructField("label_ads", T.IntegerType()),
        T.StructField("label_irrelevant", T.IntegerType()),
        T.StructField("label_rant_no_visit", T.IntegerType()),
        T.StructField("cosine_to_business", T.DoubleType()),
        T.StructField("reasons", T.StringType()),
    ]
)

# The three tasks, in report order.  A fourth label, relevant, is always 1 - irrelevant.
TASKS = ("ads", "irrelevant", "rant_no_visit")
LABELS = tuple(f"label_{t}" for t in TASKS)
SCORES = tuple(f"{t}_p" for t in TASKS)

# Every spelling of a field that raw review and business lines may use, first choice first.
REVIEW_ALIASES = {
    "business_id": ("gmap_id", "gmapid", "gmapId"),
    "user_id": ("user_id", "uid"),
    "rating": ("rating",),
    "text": ("text",),
    "time": ("time", "timestamp"),
}

BUSINESS_ALIASES = {
    "business_id": ("gmap_id", "gmapid", "gmapId"),
    "biz_name": ("name", "title"),
    "biz_cats": ("category", "categories"),
    "biz_desc": ("description", "desc"),
    "state": ("state", "province"),
    "city": ("city",),
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "lng"),
    "price": ("price",),
}


def raw_schema(aliases: dict[str, tuple[str, ...]]) -> T.StructType:
    """All aliases as strings: a typed field would drop lines that hold another JSON type."""
    names = dict.fromkeys(n for group in aliases.values() for n in group)
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
