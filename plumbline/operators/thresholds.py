"""Threshold search.

Rows never meet the grid.  Each row is mapped to the number of grid points at or below its score,
rows are counted per bucket (a handful of groups, combined on the map side), and the curve is
computed from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import f1
from plumbline.schemas import TASKS

# The three grids.
COSINE_GRID = tuple(float(x) for x in np.linspace(0.10, 0.40, 16))
ENSEMBLE_GRID = tuple(float(x) for x in np.linspace(0.30, 0.80, 11))
OOF_GRID = tuple(float(x) for x in np.linspace(0.20, 0.80, 25))


def bucket_of(score: Column, grid: Sequence[float]) -> Column:
    """How many grid points are at or below the score.  ``score >= grid[j]`` iff bucket > j."""
    return reduce(add, [(score >= F.lit(g)).cast("int") for g in grid])


def _on_grid(counts: DataFrame, grid: Sequence[float]) -> DataFrame:
    points = [F.struct(F.lit(j).alias("j"), F.lit(g).alias("thr")) for j, g in enumerate(grid)]
    exploded = counts.select("*", F.explode(F.array(*points)).alias("g"))
    return exploded.select(*counts.columns, "g.j", "g.thr")


def _sum_if(hit: Column) -> Column:
    return F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0)))


def _curve(counts: DataFrame, flagged: Column, grid: Sequence[float]) -> DataFrame:
    y = F.col("y") == 1
    sums = _on_grid(counts, grid).groupBy("label", "thr").agg(
        _sum_if(y & flagged).alias("tp"),
        _sum_if(~y & flagged).alias("fp"),
        _sum_if(y & ~flagged).alias("fn"),
    )
    return sums.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best_thresholds(curve: DataFrame) -> DataFrame:
    """``(label, thr, f1)``: the best F1, at the smallest threshold that reaches it."""
    best = F.max_by(F.struct("thr", "f1"), F.struct("f1", -F.col("thr")))
    return curve.groupBy("label").agg(best.alias("b")).select("label", "b.thr", "b.f1")


def rules_or_ml_curve(
    df: DataFrame, truths: dict[str, str], grid: Sequence[float] = ENSEMBLE_GRID
) -> DataFrame:
    """F1 of the precision-mode ensemble label at each threshold, ``(label, thr, tp, fp, fn, f1)``.

    ``truths`` maps tasks to truth columns.
    """
    entries = [
        F.struct(
            F.lit(t).alias("label"),
            F.col(y).alias("y"),
            F.col(t).alias("rule"),
            bucket_of(F.col(f"{t}_p"), grid).alias("bucket"),
        )
        for t, y in truths.items()
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    counts = long.groupBy("label", "y", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))
    rule, model = F.col("rule") == 1, F.col("bucket") > F.col("j")
    flagged = F.when(F.col("label") == "irrelevant", rule & model).otherwise(rule | model)
    return _curve(counts, flagged, grid)


def tune_rules_or_ml(
    df: DataFrame, truths: dict[str, str], grid: Sequence[float] = ENSEMBLE_GRID
) -> DataFrame:
    return best_thresholds(rules_or_ml_curve(df, truths, grid))


def oof_curve(oof: DataFrame, grid: Sequence[float] = OOF_GRID) -> DataFrame:
    """F1 of ``p >= thr`` over the pooled folds."""
    long = oof.select("label", "y", bucket_of(F.col("p"), grid).alias("bucket"))
    counts = long.groupBy("label", "y", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return _curve(counts, F.col("bucket") > F.col("j"), grid)


def tune_oof(oof: DataFrame, grid: Sequence[float] = OOF_GRID) -> DataFrame:
    """Best threshold of each task; a task without scores keeps 0.5."""
    tasks = oof.sparkSession.createDataFrame([(t,) for t in TASKS], "label string")
    best = best_thresholds(oof_curve(oof, grid))
    return tasks.join(best, "label", "left").select(
        "label", F.coalesce("thr", F.lit(0.5)).alias("thr"), "f1"
    )


def cosine_curve(
    df: DataFrame, truths: dict[str, str], grid: Sequence[float] = COSINE_GRID
) -> DataFrame:
    """Macro F1 over the four labels when reviews below each cosine threshold are irrelevant.

    Expects ``ads, rant_no_visit, offtopic, cosine_to_business`` and truth columns, one per label
    including relevant.  The similarity is computed once for the whole grid.
    """
    names = ("ads", "irrelevant", "rant_no_visit", "relevant")
    rows = df.select(
        bucket_of(F.col("cosine_to_business"), grid).alias("bucket"),
        F.col("offtopic").cast("boolean").alias("offtopic"),
        *[(F.col(t) == 1).alias(t) for t in ("ads", "rant_no_visit")],
        *[(F.col(truths[t]) == 1).alias(f"y_{t}") for t in names],
    )
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    irrelevant = (F.col("bucket") <= F.col("j")) | F.col("offtopic")
    preds = {
        "ads": F.col("ads"),
        "irrelevant": irrelevant,
        "rant_no_visit": F.col("rant_no_visit"),
        "relevant": ~irrelevant,
    }

    def score(t: str) -> Column:
        y = F.col(f"y_{t}")
        hit = [_sum_if(y & preds[t]), _sum_if(~y & preds[t]), _sum_if(y & ~preds[t])]
        return f1(*hit).alias(f"f1_{t}")

    curve = _on_grid(counts, grid).groupBy("thr").agg(*[score(t) for t in names])
    return curve.withColumn("macro_f1", reduce(add, [F.col(f"f1_{t}") for t in names]) / 4)


def best_cosine(curve: DataFrame) -> DataFrame:
    """The row with the best macro F1, at the smallest threshold that reaches it."""
    row = F.struct(*curve.columns)
    order = F.struct("macro_f1", -F.col("thr"))
    return curve.agg(F.max_by(row, order).alias("r")).select("r.*")
