"""Bot-score expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.search import count_at_or_below
from clickloom.schema import BOT_SCORE_THRESHOLD, SCORE_BUCKET_LABELS, SCORED_STATISTICS


def percentile_rank_lookup(value: str, thresholds: Sequence[float]) -> Column:
    """Highest percentile whose threshold is ``<= value``; 0 below all of them.

    ``value`` is a column name or SQL expression; ``thresholds[p]`` is the value at
    percentile ``p`` and never decreases with ``p``.
    """
    return F.greatest(count_at_or_below(value, list(thresholds)) - 1, F.lit(0))


def bot_score(
    mean: str, minimum: str, sd: str, table: Mapping[str, Sequence[float]]
) -> Column:
    """Average distance from the top percentile; 0.0 until all three statistics exist."""
    values = (mean, minimum, sd)
    shares = [
        (100 - percentile_rank_lookup(value, table[name])) / F.lit(100.0)
        for value, name in zip(values, SCORED_STATISTICS)
    ]
    missing = F.expr(" OR ".join(f"({value}) IS NULL" for value in values))
    return F.when(missing, F.lit(0.0)).otherwise((shares[0] + shares[1] + shares[2]) / F.lit(3.0))


def is_bot(score: Column, threshold: float = BOT_SCORE_THRESHOLD) -> Column:
    return score >= F.lit(threshold)


def score_bucket(score: Column) -> Column:
    """Index 0..4 of the histogram bucket."""
    last = len(SCORE_BUCKET_LABELS) - 1
    return F.least(F.lit(last), F.greatest(F.lit(0), F.floor(score / F.lit(0.2)).cast("int")))


def mean_of(total: Column, count: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count.cast("double"))


def sample_sd(count: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from exact integer moments; null below two intervals.

    With ``q`` and ``r`` the quotient and remainder of ``total / count``, the sum of squared
    deviations is ``squares - q * total - r * total / count``. All but the last division is
    whole-number arithmetic, so the result does not depend on the order rows were added in.
    """
    quotient = F.call_function("div", total, count)
    remainder = total - quotient * count
    whole = squares.cast("decimal(38,0)") - (
        quotient.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    ).cast("decimal(38,0)")
    rest = (remainder.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    deviations = whole.cast("double") - rest / count.cast("double")
    variance = F.greatest(F.lit(0.0), deviations / (count - 1).cast("double"))
    return F.when(count >= 2, F.sqrt(variance))


def square(whole: Column) -> Column:
    """Exact square of a bigint."""
    return (whole.cast("decimal(19,0)") * whole.cast("decimal(19,0)")).cast("decimal(38,0)")


def histogram_text(counts: Sequence[Column]) -> Column:
    """``label=count`` pairs in bucket order, separated by commas."""
    pairs = [
        F.concat(F.lit(f"{label}="), count.cast("string"))
        for label, count in zip(SCORE_BUCKET_LABELS, counts)
    ]
    return F.concat_ws(",", *pairs)
