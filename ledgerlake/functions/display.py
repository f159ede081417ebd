"""Presentation-side derivations expressed as Spark columns: money/number/date
formatting, string truncation, labels and severity bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed threshold values of the dashboards.
STOCK_BANDS = ((10, "red"), (20, "yellow"))            # available < 10 red, < 20 yellow
AR_AMOUNT_BANDS = ((10000, "yellow"), (50000, "red"))  # outstanding >= 10k yellow, >= 50k red
DAYS_BANDS = ((30, "yellow"), (60, "orange"), (90, "dark-red"))  # days >= 30/60/90


def format_currency(x: Column) -> Column:
    """en-US currency: 1234.5 -> '$1,234.50', -5 -> '-$5.00'."""
    body = F.concat(F.lit("$"), F.format_number(F.abs(x).cast("double"), 2))
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def format_number(x: Column) -> Column:
    """Grouped display with up to three fraction digits: 1234567.5 -> '1,234,567.5'."""
    return F.call_function("format_number", x, F.lit("#,##0.###"))


def format_date(ts: Column) -> Column:
    """en-US medium date: 'Jan 3, 2024'."""
    return F.date_format(ts, "MMM d, yyyy")


def format_datetime(ts: Column) -> Column:
    """en-US date and time: 'Jan 3, 2024, 4:05 PM'."""
    return F.date_format(ts, "MMM d, yyyy, h:mm a")


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def band_below(x: Column, bands, default: str) -> Column:
    """First label whose threshold x is strictly below; else default."""
    out = None
    for limit, label in bands:
        out = (F.when(x < limit, label) if out is None else out.when(x < limit, label))
    return out.otherwise(default)


def band_at_least(x: Column, bands, default: str) -> Column:
    """Label of the highest threshold x reaches; else default."""
    out = None
    for limit, label in sorted(bands, reverse=True):
        out = (F.when(x >= limit, label) if out is None else out.when(x >= limit, label))
    return out.otherwise(default)


def safe_div(num: Column, den: Column, default=0.0) -> Column:
    """num / den as DOUBLE, ``default`` when den is 0 or NULL."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(default))
