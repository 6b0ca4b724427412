"""The batch jobs: each reads, calls operators and writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.clean import (
    dedup_reviews,
    fill_null_text,
    keep_english,
    map_source_schema,
    pick_context,
)
from plumbline.operators.ensemble import attach_scores, combine, ensemble_output, ensemble_reasons
from plumbline.operators.evaluate import align_predictions, autolabel_truth
from plumbline.operators.features import featurize_metadata
from plumbline.operators.ingest import business_table, enrich_business, review_rows
from plumbline.operators.metrics import avg_report, error_slice, label_report
from plumbline.operators.rules import add_rule_labels, pseudo_label, rules_label
from plumbline.policy import DEFAULT_POLICY, Policy
from plumbline.schemas import BUSINESS_ALIASES, REVIEW_ALIASES
from plumbline.sources.readers import scan_jsonl


def ingest_job(
    spark: SparkSession,
    review_paths: str | Sequence[str],
    business_paths: str | Sequence[str],
    state: str = "",
    partitions: int | None = None,
) -> DataFrame:
    """Raw JSON lines to canonical reviews."""
    reviews = review_rows(scan_jsonl(spark, review_paths, REVIEW_ALIASES, partitions))
    businesses = business_table(scan_jsonl(spark, business_paths, BUSINESS_ALIASES))
    return enrich_business(reviews, businesses, state)


def featurize_job(reviews: DataFrame) -> DataFrame:
    return featurize_metadata(reviews)


def preprocess_job(
    raw: DataFrame, label: bool = False, lang: str | None = None, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Restaurant source rows: map, keep English, drop copies, and label if asked.

    ``lang`` names a column with the language of each row.
    """
    kept = keep_english(raw, lang) if lang else raw
    clean = dedup_reviews(map_source_schema(kept))
    return add_rule_labels(clean, policy) if label else clean


def weak_label_job(reviews: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Canonical reviews plus weak labels."""
    return pseudo_label(reviews, policy)


def predict_job(
    reviews: DataFrame,
    scores: DataFrame,
    mode: str = "precision",
    thresholds: DataFrame | Mapping[str, float] | None = None,
    policy: Policy = DEFAULT_POLICY,
) -> DataFrame:
    """Rules and scores combined into published predictions."""
    keep = tuple(dict.fromkeys(("review_id", *reviews.columns)))
    ruled = rules_label(fill_null_text(reviews), policy, keep=keep).drop("reasons")
    merged = combine(attach_scores(ruled, scores), mode, thresholds)
    return ensemble_output(ensemble_reasons(merged, mode, thresholds))


@dataclass
class Evaluation:
    labels: DataFrame
    averages: DataFrame
    errors: DataFrame


def evaluate_job(
    truth: DataFrame, preds: DataFrame, policy: Policy = DEFAULT_POLICY, all_labels: bool = False
) -> Evaluation:
    """Reports and error rows of predictions against truth, or against rules where truth lacks
    labels."""
    joined, pairs = align_predictions(autolabel_truth(truth, policy), preds)
    context = [*pick_context(truth.columns), *[p.truth for p in pairs]]
    return Evaluation(
        label_report(joined, pairs),
        avg_report(joined, pairs),
        error_slice(joined, pairs, context, all_labels),
    )


def flagged_per_business(reviews: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """How many ads and rants each business collects, from row-local rules only."""
    from plumbline.functions.text import norm_rules
    from plumbline.operators.rules import ads_hit, rant_hit

    text = reviews.select("business_id", norm_rules(F.col("review_text")).alias("t"))
    return text.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(ads_hit(F.col("t"), policy)).alias("n_ads"),
        F.count_if(rant_hit(F.col("t"), policy)).alias("n_rants"),
    )
