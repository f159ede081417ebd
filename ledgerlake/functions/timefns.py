"""Time helpers.  Every time-dependent operator takes an explicit ``as_of``
(never ``current_timestamp()``) so results are reproducible and back-fillable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_ts(as_of) -> Column:
    """Literal TIMESTAMP_NTZ for ``as_of`` ('YYYY-MM-DD[ HH:MM:SS]' or datetime)."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def as_of_date(as_of) -> Column:
    return as_of_ts(as_of).cast("date")


def trunc_ntz(unit: str, ts: Column) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ (Spark returns TIMESTAMP)."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hours_before(as_of, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(-int(hours)), as_of_ts(as_of))


def days_before(as_of, days: int) -> Column:
    """Midnight of (as_of date - days), as TIMESTAMP_NTZ."""
    return F.date_sub(as_of_date(as_of), int(days)).cast("timestamp_ntz")


def ceil_to_hour(ts: Column) -> Column:
    """Smallest whole hour >= ts.  ``date_trunc('hour', x) >= t`` is equivalent
    to ``x >= ceil_to_hour(t)``, a predicate on the raw column that reaches the
    Parquet scan as a pushed filter."""
    t = trunc_ntz("hour", ts)
    return F.when(t == ts, t).otherwise(F.timestamp_add("HOUR", F.lit(1), t))


def days_between(end: Column, start: Column) -> Column:
    """Whole days ``end - start`` (Spark ``datediff(end, start)``)."""
    return F.datediff(end, start)
