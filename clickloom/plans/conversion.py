"""Batch jobs: event files to session features, and features to an evaluated model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickloom.operators.evaluate import (
    classification_metrics,
    confusion_matrix,
    downsample_curve,
    model_comparison,
    roc_auc,
    roc_curve,
    score_steps,
)
from clickloom.operators.model import (
    ConversionModel,
    feature_importance,
    predict_sessions,
    train_conversion_model,
)
from clickloom.operators.quality import expect_column_subset, expect_row_count, expect_split_nonempty
from clickloom.operators.sessions import (
    activity_outlier_filter,
    session_features,
    split_counts,
    staging_events,
    train_test_split,
)
from clickloom.schema import FEATURE_COLUMNS
from clickloom.session import materialize
from clickloom.sources.sinks import create_or_replace_table, export_features, publish_artifacts


def build_features(events: DataFrame, tables: dict[str, str], expected_rows: int | None = None) -> DataFrame:
    """Load, stage, aggregate and filter events into the feature export.

    ``tables`` names where to keep ``events``, ``sessions`` and the ``features`` path.
    """
    loaded = create_or_replace_table(events, tables["events"])
    expect_row_count(loaded, expected_rows)
    sessions = create_or_replace_table(session_features(staging_events(loaded)), tables["sessions"])
    return export_features(activity_outlier_filter(sessions), tables["features"])


def train_and_evaluate(features: DataFrame, base: str, **model_options) -> ConversionModel:
    """Split, train, score the test part and publish the five evaluation tables."""
    expect_column_subset(features, [*FEATURE_COLUMNS, "converted"])
    expect_split_nonempty(split_counts(features))
    train, test = train_test_split(features)
    model = train_conversion_model(train, **model_options)
    scored = materialize(predict_sessions(model, test), "scored-sessions")
    steps = materialize(score_steps(scored), "steps")
    matrix = confusion_matrix(scored)
    auc = roc_auc(steps).unpivot([], ["roc_auc"], "metric", "value")
    publish_artifacts(
        {
            "metrics": auc.unionByName(classification_metrics(matrix)),
            "model_comparison": model_comparison(scored),
            "confusion_matrix": matrix,
            "feature_importance": feature_importance(model),
            "roc_curve": downsample_curve(roc_curve(steps)),
        },
        base,
    )
    return model
