"""Truth against predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import coerce_label
from plumbline.operators.clean import assert_unique
from plumbline.operators.metrics import Pair
from plumbline.operators.rules import rules_label
from plumbline.policy import DEFAULT_POLICY, Policy
from plumbline.schemas import LABELS, TASKS

# Spellings of prediction columns, first choice first.
PREDICTION_FORMS = (
    "label_{}_pred", "{}_pred", "label_{}", "{}", "pred_label_{}", "pred_{}", "y_pred_{}",
)


def resolve_predictions(columns: Sequence[str]) -> dict[str, str]:
    """Task to prediction column, out of the columns of the prediction table alone.

    Truth columns are never candidates, so truth can not be compared with itself.
    """
    for form in PREDICTION_FORMS:
        names = {t: form.format(t) for t in TASKS}
        if all(n in columns for n in names.values()):
            return names
    guess = {t: next((c for c in columns if c.endswith((t, f"{t}_pred"))), None) for t in TASKS}
    missing = [t for t, c in guess.items() if c is None]
    if missing:
        raise ValueError(f"no prediction column for: {missing}")
    return guess


def autolabel_truth(truth: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Truth as given; if any label is missing, all three come from the rules."""
    if all(c in truth.columns for c in LABELS):
        return truth
    keep = tuple(c for c in truth.columns if c not in LABELS)
    labeled = rules_label(truth, policy, keep=keep)
    return labeled.select(*keep, *[F.col(t).alias(lab) for t, lab in zip(TASKS, LABELS)])


def join_truth_preds(truth: DataFrame, preds: DataFrame, key: str = "review_id") -> DataFrame:
    """Inner join; a name on both sides gets ``_gt`` and ``_pred``.  Keys of predictions must differ."""
    assert_unique(preds, key)
    both = set(truth.columns) & set(preds.columns) - {key}
    left = truth.withColumnsRenamed({c: f"{c}_gt" for c in both})
    right = preds.withColumnsRenamed({c: f"{c}_pred" for c in both})
    return left.join(right, key, "inner")


def align_predictions(
    truth: DataFrame, preds: DataFrame, key: str = "review_id"
) -> tuple[DataFrame, list[Pair]]:
    """Truth context with clean 0/1 columns ``<label>`` and ``<label>_hat``, and their pairs.

    Only labels that truth has are aligned.
    """
    assert_unique(preds, key)
    found = resolve_predictions([c for c in preds.columns if c != key])
    tasks = [t for t in TASKS if f"label_{t}" in truth.columns]
    hats = preds.select(key, *[coerce_label(F.col(found[t])).alias(f"label_{t}_hat") for t in tasks])
    clean = truth.withColumns({f"label_{t}": F.col(f"label_{t}").cast("int") for t in tasks})
    pairs = [Pair(f"label_{t}", f"label_{t}", f"label_{t}_hat") for t in tasks]
    return clean.join(hats, key, "inner"), pairs
