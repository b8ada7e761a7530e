"""Sorted lookups as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    """A Python number, string or tuple as SQL text."""
    if isinstance(value, tuple):
        return f"struct({', '.join(sql_literal(part) for part in value)})"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return f"{value}L"


def count_at_or_below(value: str, bounds: Sequence) -> Column:
    """How many of the sorted ``bounds`` are ``<= value``; 0 when ``value`` is null.

    ``value`` is a column name or SQL expression. The lookup is a binary search over a constant
    array, log2(len(bounds)) steps. Its code stays small for any number of bounds: a tree of
    comparisons grows beyond the size up to which the JVM compiles a method. A bound may be a
    tuple when ``value`` is a struct.
    """
    if not bounds:
        return F.lit(0)
    steps = ", ".join(str(1 << bit) for bit in reversed(range(len(bounds).bit_length())))
    return F.expr(
        f"aggregate(array({steps}), 0, (found, step) -> CASE WHEN found + step <= {len(bounds)} AND "
        f"{value} >= array({', '.join(sql_literal(bound) for bound in bounds)})[found + step - 1] "
        "THEN found + step ELSE found END)"
    )
