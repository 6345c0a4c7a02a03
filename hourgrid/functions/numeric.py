"""Null-safe arithmetic (ANSI mode raises on /0 and bad casts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Text -> double; text that is no number -> NULL."""
    return _c(c).try_cast("double")


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0.0)))


def share_pct(part: str | Column, total: str | Column) -> Column:
    """Share of ``total`` in percent; a zero or missing total gives 0."""
    return F.coalesce(safe_div(part, total) * F.lit(100.0), F.lit(0.0))


# Exact type for sums of measured values: 17 integer and 10 fraction digits (sums have 27, and a
# difference of two sums keeps all 10 decimals).  A value of
# 1e17 or more raises; what lies under the tenth decimal is rounded.
EXACT = "decimal(27,10)"


def exact_sum(c: str | Column) -> Column:
    """Sum as an exact decimal: the result does not depend on the order of addition."""
    return F.sum(_c(c).cast(EXACT))


def exact_avg(c: str | Column) -> Column:
    """Mean of the non-null values via an exact sum (order-independent); NULL if none."""
    return F.try_divide(exact_sum(c).cast("double"), F.count(_c(c)).cast("double"))
