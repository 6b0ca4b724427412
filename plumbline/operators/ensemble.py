"""Rules and model scores combined."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.clean import assert_unique
from plumbline.schemas import LABELS, SCORES, TASKS
from plumbline.sources.sinks import threshold_values

MODES = ("precision", "recall", "balanced", "rules", "model")

# Fixed value: a score this high stands in for a rule in balanced mode.
HIGH_SCORE = 0.6

OUTPUT_COLUMNS = (
    "review_id",
    "business_id",
    "biz_name",
    "biz_cats",
    "review_text",
    *LABELS,
    "label_relevant",
    *SCORES,
    "reasons",
)


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "review_id") -> DataFrame:
    """Join scores made elsewhere; a label or review that was not scored counts as 0.

    Keys of the scores must differ, or reviews would multiply.
    """
    assert_unique(scores, key)
    have = [c for c in SCORES if c in scores.columns]
    joined = df.join(scores.select(key, *have), key, "left")
    filled = {
        c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in SCORES
    }
    return joined.withColumns(filled)


def threshold_decide(
    df: DataFrame, thresholds: DataFrame | Mapping[str, float] | None = None
) -> DataFrame:
    """Add ``<task>_model``: 1 where the score reaches its threshold."""
    values = threshold_values(thresholds)
    decided = {f"{t}_model": (F.col(f"{t}_p") >= values[t]).cast("int") for t in TASKS}
    return df.withColumns(decided)


def _irrelevant(mode: str, rule: Column, model: Column, score: Column, thr: float) -> Column:
    return {
        "precision": rule & model,
        "recall": rule | model,
        "balanced": model & (rule | (score >= max(HIGH_SCORE, thr))),
        "rules": rule,
        "model": model,
    }[mode]


def combine(
    df: DataFrame,
    mode: str = "precision",
    thresholds: DataFrame | Mapping[str, float] | None = None,
) -> DataFrame:
    """Add the four ``label_*`` columns and ``prob_irrelevant``.

    Expects rule columns ``ads, irrelevant, rant_no_visit`` and score columns ``*_p`` in one row.
    Ads and rants are flagged by either side; how irrelevant is decided depends on ``mode``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    values = threshold_values(thresholds)
    rule = {t: F.col(t) == 1 for t in TASKS}
    score = {t: F.col(f"{t}_p") for t in TASKS}
    model = {t: score[t] >= values[t] for t in TASKS}
    either = {t: rule[t] | model[t] for t in ("ads", "rant_no_visit")}
    if mode == "rules":
        either = {t: rule[t] for t in either}
    elif mode == "model":
        either = {t: F.lit(False) for t in either}
    irrelevant = _irrelevant(
        mode, rule["irrelevant"], model["irrelevant"], score["irrelevant"], values["irrelevant"]
    )
    return df.withColumns(
        {
            "label_ads": either["ads"].cast("int"),
            "label_irrelevant": irrelevant.cast("int"),
            "label_rant_no_visit": either["rant_no_visit"].cast("int"),
            "label_relevant": F.lit(1) - irrelevant.cast("int"),
            "prob_irrelevant": F.lit(0.0) if mode == "rules" else score["irrelevant"],
        }
    )


def ensemble_reasons(
    df: DataFrame,
    mode: str = "precision",
    thresholds: DataFrame | Mapping[str, float] | None = None,
) -> DataFrame:
    """``reasons`` as text: which side flagged what.

    In precision mode a fired irrelevant rule always reads ``rule+model``, even if the model
    disagreed; downstream readers rely on that text.
    """
    values = threshold_values(thresholds)
    model = {t: F.col(f"{t}_p") >= values[t] for t in TASKS}
    score = F.format_string("%.2f", F.col("irrelevant_p"))
    both = F.concat(F.lit("irr:rule+model(p="), score, F.lit(")"))
    either = F.concat(F.lit("irr:rule|model(p="), score, F.lit(")"))
    rule = F.col("irrelevant") == 1
    irrelevant = F.when(rule & F.lit(mode == "precision"), both).when(
        rule | model["irrelevant"], either
    )
    said = F.array_compact(
        F.array(
            F.when(F.col("ads") == 1, F.lit("ads:rule")),
            F.when(model["ads"], F.lit("ads:model")),
            F.when(F.col("rant_no_visit") == 1, F.lit("rant:rule")),
            F.when(model["rant_no_visit"], F.lit("rant:model")),
            irrelevant,
        )
    )
    return df.withColumn("reasons", F.array_join(said, "; "))


def score_note(df: DataFrame, source: str = "ml") -> DataFrame:
    """Append the three scores to rule reasons given as text; ``source`` names the scorer."""
    note = F.format_string(
        f" | {source}_p={{ads:%.2f, irr:%.2f, rant:%.2f}}", *[F.col(c) for c in SCORES]
    )
    return df.withColumn("reasons", F.concat(F.coalesce("reasons", F.lit("")), note))


def ensemble_output(df: DataFrame) -> DataFrame:
    """The published columns, those that are present."""
    return df.select(*[c for c in OUTPUT_COLUMNS if c in df.columns])
