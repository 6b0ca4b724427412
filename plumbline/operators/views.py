"""Views over predictions, as a reviewer of results would ask for them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.schemas import LABELS

SEARCHED = ("review_text", "biz_name", "biz_cats")


def search_reviews(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Rows whose text, business name or categories hold the query, in any letter case."""
    if not query.strip():
        return df
    needle = query.lower()
    cells = [F.lower(F.col(c)) for c in SEARCHED]
    hits = [c.rlike(needle) if regex else c.contains(needle) for c in cells]
    return df.filter(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]))


def flagged_only(df: DataFrame) -> DataFrame:
    return df.filter(reduce(or_, [F.col(c) == 1 for c in LABELS]))


def sort_by_prob(df: DataFrame, prob: str = "prob_irrelevant", n: int | None = None) -> DataFrame:
    """Most probable first, ties by key.  With ``n`` only the top rows are kept and moved."""
    ordered = df.orderBy(F.col(prob).desc(), "review_id")
    return ordered.limit(n) if n else ordered


def prob_histogram(df: DataFrame, prob: str = "prob_irrelevant", bins: int = 10) -> DataFrame:
    """``(bin, count)`` over [0, 1]; the last bin includes 1, empty bins are kept."""
    p = F.col(prob)
    i = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(p.between(0.0, 1.0)).groupBy(i.alias("i")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("i"))
    return edges.join(counts, "i", "left").select(
        (F.col("i") / bins).alias("bin"), F.coalesce("n", F.lit(0)).alias("count")
    )
