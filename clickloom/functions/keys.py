"""Conditions on key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_session(key: str) -> Column:
    """Whether a session key holds more than white space; blank keys name no session."""
    return F.coalesce(F.col(key).cast("string").rlike(r"\S"), F.lit(False))
