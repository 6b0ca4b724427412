"""Classification reports.

Every report is one pass over the rows: all counts of all labels are sums of a single global
aggregation, and what follows works on that one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize


@dataclass(frozen=True)
class Pair:
    """A label with its truth and prediction columns, both 0/1."""

    label: str
    truth: str
    pred: str


def ratio(x: Column, y: Column) -> Column:
    """``x / y``, and 0 where ``y`` is 0."""
    return F.coalesce(x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def _cells(y: Column, yhat: Column) -> dict[str, Column]:
    return {
        "tn": (y == 0) & (yhat == 0),
        "fp": (y == 0) & (yhat == 1),
        "fn": (y == 1) & (yhat == 0),
        "tp": (y == 1) & (yhat == 1),
    }


def _counts(pair: Pair) -> Column:
    cells = _cells(F.col(pair.truth), F.col(pair.pred))
    return F.struct(
        F.lit(pair.label).alias("label"),
        *[F.count_if(hit).alias(name) for name, hit in cells.items()],
    )


def confusion_counts(
    df: DataFrame, pairs: Sequence[Pair], by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., label, tn, fp, fn, tp)``."""
    grouped = df.groupBy(*by).agg(F.array(*[_counts(p) for p in pairs]).alias("rows"))
    return grouped.select(*by, F.explode("rows").alias("r")).select(*by, "r.*")


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f1(tp, fp, fn),
            "support": tp + fn,
        }
    )


def label_report(df: DataFrame, pairs: Sequence[Pair], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, precision, recall, f1, support)``."""
    scored = _scores(confusion_counts(df, pairs, by))
    return scored.select(*by, "label", "precision", "recall", "f1", "support")


def avg_report(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Micro, macro, weighted and samples averages.

    The samples average scores each row over its labels, then takes the mean over rows.
    """
    def total(hits: list[Column]) -> Column:
        return reduce(add, [h.cast("int") for h in hits])

    cells = [_cells(F.col(p.truth), F.col(p.pred)) for p in pairs]
    tp, fp, fn = (total([c[k] for c in cells]) for k in ("tp", "fp", "fn"))
    one = df.agg(
        F.array(*[_counts(p) for p in pairs]).alias("rows"),
        F.struct(
            F.avg(ratio(tp, tp + fp)).alias("precision"),
            F.avg(ratio(tp, tp + fn)).alias("recall"),
            F.avg(f1(tp, fp, fn)).alias("f1"),
        ).alias("samples"),
    )
    labels = _scores(one.select("samples", F.explode("rows").alias("r")).select("samples", "r.*"))
    t, p, n, s = (F.sum(c) for c in ("tp", "fp", "fn", "support"))

    def row(name: str, precision: Column, recall: Column, score: Column) -> Column:
        return F.struct(
            F.lit(name).alias("average"),
            F.coalesce(precision, F.lit(0.0)).alias("precision"),
            F.coalesce(recall, F.lit(0.0)).alias("recall"),
            F.coalesce(score, F.lit(0.0)).alias("f1"),
            s.alias("support"),
        )

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), s)

    rows = F.array(
        row("micro avg", ratio(t, t + p), ratio(t, t + n), f1(t, p, n)),
        row("macro avg", *[F.avg(c) for c in ("precision", "recall", "f1")]),
        row("weighted avg", *[weighted(c) for c in ("precision", "recall", "f1")]),
        row("samples avg", *[F.first(f"samples.{c}") for c in ("precision", "recall", "f1")]),
    )
    return labels.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def single_label_report(df: DataFrame, pair: Pair) -> DataFrame:
    """Scores of the positive class, and the macro average over both classes."""
    counts = confusion_counts(df, [pair])
    positive = _scores(counts)
    flipped = counts.select(
        "label",
        F.col("tp").alias("tn"),
        F.col("fn").alias("fp"),
        F.col("fp").alias("fn"),
        F.col("tn").alias("tp"),
    )
    names = ("precision", "recall", "f1")
    macro = positive.unionByName(_scores(flipped)).agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(c).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return positive.select("label", *names, "support").unionByName(macro)


def fold_macro(df: DataFrame, pairs: Sequence[Pair], fold: str = "fold") -> DataFrame:
    """Macro precision, recall and F1 of each fold, averaged over folds."""
    names = ("precision", "recall", "f1")
    per_fold = label_report(df, pairs, [fold]).groupBy(fold).agg(*[F.avg(c).alias(c) for c in names])
    return per_fold.agg(*[F.avg(c).alias(c) for c in names])


def error_slice(
    df: DataFrame, pairs: Sequence[Pair], context: Sequence[str], all_labels: bool = False
) -> DataFrame:
    """False positives and false negatives with their context and an ``error_type``.

    By default only the first label that has any error is reported.
    """
    kinds = []
    for i, p in enumerate(pairs):
        cells = _cells(F.col(p.truth), F.col(p.pred))
        kind = F.when(cells["fp"], F.lit(f"{p.label}_FP")).when(cells["fn"], F.lit(f"{p.label}_FN"))
        kinds.append(F.when(kind.isNotNull(), F.struct(F.lit(i).alias("i"), kind.alias("kind"))))
    found = F.array_compact(F.array(*kinds))
    flagged = df.withColumn("_errors", found).filter(F.size("_errors") > 0)
    rows = flagged.select(*context, F.explode("_errors").alias("e"))
    if not all_labels:
        rows = materialize(rows, "errors")  # the input is worked out once; errors are few
        rows = rows.filter(F.col("e.i") == rows.agg(F.min("e.i")).scalar())
    return rows.select(*context, F.col("e.kind").alias("error_type"))
