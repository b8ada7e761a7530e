"""Evaluation of a scored binary label: confusion matrix, metrics, ROC and precision-recall.

The curve needs cumulative counts over all distinct scores. Rows are first counted per score,
then added up across sorted score ranges, so no task sees more than a range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ordering import CHUNK, row_positions, running_in_order, with_chunks

METRIC_ORDER = [
    "accuracy",
    "balanced_accuracy",
    "precision_false",
    "recall_false",
    "f1_false",
    "precision_true",
    "recall_true",
    "f1_true",
    "macro_f1",
    "weighted_f1",
]
CURVE_POINTS = 1_000


def confusion_matrix(df: DataFrame, label: str = "converted", predicted: str = "prediction") -> DataFrame:
    """Four rows ``(actual, predicted, count)``; combinations that do not occur count 0."""
    actual, guess = F.col(label).cast("boolean"), F.col(predicted).cast("boolean")
    cells = {
        "False,False": ~actual & ~guess,
        "False,True": ~actual & guess,
        "True,False": actual & ~guess,
        "True,True": actual & guess,
    }
    counted = df.agg(*[F.count_if(hit).alias(name) for name, hit in cells.items()])
    long = counted.unpivot([], [F.col(f"`{name}`") for name in cells], "cell", "count")
    return long.select(
        F.split_part("cell", F.lit(","), F.lit(1)).alias("actual"),
        F.split_part("cell", F.lit(","), F.lit(2)).alias("predicted"),
        "count",
    )


def _ratio(top, bottom):
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def wide_metrics(matrix: DataFrame) -> DataFrame:
    """All metrics of one confusion matrix as one row; a zero denominator gives 0."""

    def cell(actual: str, predicted: str):
        hit = (F.col("actual") == actual) & (F.col("predicted") == predicted)
        return F.sum(F.when(hit, F.col("count")).otherwise(0))

    counts = matrix.agg(
        cell("False", "False").alias("tn"),
        cell("False", "True").alias("fp"),
        cell("True", "False").alias("fn"),
        cell("True", "True").alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    negatives, positives = tn + fp, tp + fn
    total = negatives + positives
    f1_false = _ratio(2 * tn, 2 * tn + fp + fn)
    f1_true = _ratio(2 * tp, 2 * tp + fp + fn)
    recall_false, recall_true = _ratio(tn, negatives), _ratio(tp, positives)
    both = (negatives > 0) & (positives > 0)
    balanced = F.when(both, (recall_false + recall_true) / 2).otherwise(recall_false + recall_true)
    values = {
        "accuracy": _ratio(tn + tp, total),
        "balanced_accuracy": balanced,
        "precision_false": _ratio(tn, tn + fn),
        "recall_false": recall_false,
        "f1_false": f1_false,
        "precision_true": _ratio(tp, tp + fp),
        "recall_true": recall_true,
        "f1_true": f1_true,
        "macro_f1": (f1_false + f1_true) / 2,
        "weighted_f1": F.when(total == 0, F.lit(0.0)).otherwise(
            (f1_false * negatives + f1_true * positives) / total
        ),
    }
    return counts.select(*[values[name].alias(name) for name in METRIC_ORDER])


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Rows ``(metric, value)``."""
    return wide_metrics(matrix).unpivot([], METRIC_ORDER, "metric", "value")


def score_steps(
    df: DataFrame, label: str = "converted", score: str = "score", chunks: int | None = None
) -> DataFrame:
    """One row per distinct score: its positives and negatives, and those at or above it."""
    hit = F.col(label).cast("boolean")
    counted = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(hit).alias("positives"), F.count_if(~hit).alias("negatives")
    )
    chunked = with_chunks(counted.withColumn("_rank", -F.col("score")), ["_rank"], chunks)
    summed = running_in_order(
        chunked, [], ["_rank"], {"tp": ("sum", "positives"), "fp": ("sum", "negatives")}
    )
    return summed.drop(CHUNK, "_rank")


def _class_totals(steps: DataFrame) -> tuple[int, int]:
    row = steps.agg(F.max("tp").alias("p"), F.max("fp").alias("n")).first()
    return row["p"] or 0, row["n"] or 0


def roc_curve(steps: DataFrame) -> DataFrame:
    """``(fpr, tpr, threshold)`` for every distinct score, plus the origin."""
    positives, negatives = _class_totals(steps)

    def rate(count: str, total: int):
        return F.lit(None).cast("double") if total == 0 else F.col(count) / F.lit(float(total))

    points = steps.select(
        rate("fp", negatives).alias("fpr"),
        rate("tp", positives).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    origin = steps.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return origin.unionByName(points)


def roc_auc(steps: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, in whole numbers until the last division."""
    wide = "decimal(19,0)"
    doubled = F.col("negatives").cast(wide) * (2 * F.col("tp") - F.col("positives")).cast(wide)
    totals = steps.agg(
        F.sum(doubled.cast("decimal(38,0)")).alias("area"),
        F.max("tp").alias("p"),
        F.max("fp").alias("n"),
    )
    scale = F.lit(2.0) * F.col("p") * F.col("n")
    return totals.select(F.when(scale > 0, F.col("area").cast("double") / scale).alias("roc_auc"))


def average_precision(steps: DataFrame) -> DataFrame:
    """Sum over thresholds of recall gained times precision."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    totals = steps.agg(
        F.sum(F.col("positives") * precision).alias("weighted"), F.max("tp").alias("p")
    )
    value = F.when(F.col("p") > 0, F.col("weighted") / F.col("p")).otherwise(F.lit(0.0))
    return totals.select(value.alias("average_precision"))


def downsample_curve(curve: DataFrame, max_points: int = CURVE_POINTS, chunks: int | None = None) -> DataFrame:
    """Evenly spaced rows of a long curve, first and last included; short curves unchanged."""
    total = curve.count()
    if total <= max_points:
        return curve
    kept = sorted({int(i) for i in np.linspace(0, total - 1, max_points, dtype=int)})
    ranked = curve.withColumn("_rank", -F.col("threshold"))
    placed = row_positions(ranked, ["_rank"], "_position", chunks)
    return placed.where(F.col("_position").isin(kept)).select(*curve.columns)


def _comparison_row(name: str, df: DataFrame, label: str, predicted: str, steps: DataFrame) -> DataFrame:
    metrics = wide_metrics(confusion_matrix(df, label, predicted))
    return metrics.select(
        F.lit(name).alias("model"),
        "accuracy",
        "balanced_accuracy",
        F.col("f1_true").alias("true_class_f1"),
        roc_auc(steps).scalar().alias("roc_auc"),
        average_precision(steps).scalar().alias("pr_auc"),
    )


def model_comparison(
    df: DataFrame,
    label: str = "converted",
    score: str = "score",
    model_name: str = "Boosted trees",
    cutoff: float = 0.5,
) -> DataFrame:
    """The scored model next to always predicting False."""
    judged = df.select(
        F.col(label).alias("label"),
        F.col(score).alias("score"),
        (F.col(score) >= cutoff).alias("guess"),
        F.lit(False).alias("never"),
        F.lit(0.0).alias("flat"),
    )
    baseline = _comparison_row(
        "Always predict False", judged, "label", "never", score_steps(judged, "label", "flat")
    )
    model = _comparison_row(
        model_name, judged, "label", "guess", score_steps(judged, "label", "score")
    )
    return baseline.unionByName(model)
