"""Small numeric expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def report_round(value: Column, digits: int = 4) -> Column:
    """Half-even rounding for report columns; apply it to outputs only, never before aggregating."""
    return F.bround(value, digits)


def rate(condition: Column) -> Column:
    """Share of rows where ``condition`` is true (NULL counts as false); 0 on no rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def rate_within(condition: Column, subset: Column) -> Column:
    """:func:`rate` over the rows where ``subset`` holds."""
    flag = F.coalesce(condition, F.lit(False)).cast("double")
    return F.coalesce(F.avg(F.when(subset, flag)), F.lit(0.0))


def clamp(value: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Limit a score to the rubric range; NULL stays NULL (``greatest`` alone would skip it)."""
    limited = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))
    return F.when(value.isNotNull(), limited)


def ten_scale(score: Column) -> Column:
    """Rescale 1..5 to 0..10."""
    return (score - F.lit(1.0)) / F.lit(4.0) * F.lit(10.0)


def speed(tokens: Column, total_s: Column, first_s: Column) -> list[Column]:
    """Tokens per second, decode tokens per second and time to first token."""
    n = tokens.cast("double")
    decode_s = total_s - F.coalesce(first_s, F.lit(0.0))
    return [
        F.when(total_s > 0, n / total_s).otherwise(0.0).alias("tok_per_s"),
        F.when((n > 1) & (decode_s > 0), (n - 1) / decode_s).otherwise(0.0)
        .alias("decode_tok_per_s"),
        F.coalesce(first_s, F.lit(0.0)).alias("ttft"),
    ]
