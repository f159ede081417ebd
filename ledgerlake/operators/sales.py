"""Sales rollups over the order event log.

All rollups are plain hash aggregates: Spark does a map-side partial aggregate
before the shuffle, so a hot hour or day costs one row per map task in the
exchange.  The exact distinct count is planned as a two-level aggregate keyed
first by (hour, customer), which also spreads a hot hour across reducers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import safe_div
from ..functions.timefns import (ceil_to_hour, days_before, hours_before,
                                 trunc_ntz)
from ..schemas import MONEY_SUM


def _created(order_events: DataFrame) -> DataFrame:
    return order_events.filter(F.col("event_type") == "order_created")


def sales_by_hour(order_events: DataFrame) -> DataFrame:
    """Hourly rollup: orders, revenue, average order value (0 if none),
    distinct customers; ``updated_at`` = latest event time in the hour."""
    agg = (_created(order_events)
           .groupBy(trunc_ntz("hour", F.col("event_timestamp")).alias("hour"))
           .agg(F.count(F.lit(1)).alias("total_orders"),
                F.sum("total_amount").cast(MONEY_SUM).alias("total_revenue"),
                F.countDistinct("customer_id").alias("unique_customers"),
                F.max("event_timestamp").alias("updated_at")))
    return agg.select(
        "hour", "total_orders", "total_revenue",
        safe_div(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
        "unique_customers", "updated_at")


def sales_since(order_events: DataFrame, cutoff) -> DataFrame:
    """``sales_by_hour`` restricted to ``hour >= cutoff``.  The restriction is
    also applied to the raw timestamp (ceil to the hour) so it is pushed into
    the scan instead of being evaluated after the aggregate."""
    pre = order_events.filter(F.col("event_timestamp") >= ceil_to_hour(cutoff))
    return sales_by_hour(pre).filter(F.col("hour") >= cutoff)


def sales_hourly(order_events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Hourly sales for the last ``hours`` hours, newest first."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must be within 1..168")
    return sales_since(order_events, hours_before(as_of, hours)).orderBy(F.col("hour").desc())


def sales_recent(order_events: DataFrame, as_of, hours: int, limit: int = 100) -> DataFrame:
    """Named queries ``sales_24h`` / ``sales_7d``: newest ``limit`` hours."""
    return (sales_since(order_events, hours_before(as_of, hours))
            .orderBy(F.col("hour").desc()).limit(limit))


def daily_order_volume(order_events: DataFrame) -> DataFrame:
    """Per day: distinct orders, revenue, mean order amount."""
    return (_created(order_events)
            .groupBy(trunc_ntz("day", F.col("event_timestamp")).alias("order_date"))
            .agg(F.countDistinct("order_id").alias("total_orders"),
                 F.sum("total_amount").cast(MONEY_SUM).alias("total_revenue"),
                 F.count("total_amount").alias("_n"))
            .select("order_date", "total_orders", "total_revenue",
                    F.try_divide(F.col("total_revenue").cast("double"), F.col("_n"))
                     .alias("avg_order_value")))


def daily_orders(order_events: DataFrame, as_of, days: int = 30, limit: int | None = 100) -> DataFrame:
    """Named query ``daily_orders``: the daily view over the last ``days`` days, newest
    first; all of them without a ``limit``."""
    if not 1 <= days <= 365:
        raise ValueError("days must be within 1..365")
    cutoff = days_before(as_of, days)
    pre = order_events.filter(F.col("event_timestamp") >= cutoff)
    out = daily_order_volume(pre).filter(F.col("order_date") >= cutoff)
    return out if limit is None else out.orderBy(F.col("order_date").desc()).limit(limit)


def revenue_by_day(order_events: DataFrame, as_of, days: int = 30, limit: int = 100) -> DataFrame:
    """Named query ``revenue_by_day``: the daily rollup with the look-back
    applied to the raw event time."""
    pre = order_events.filter(F.col("event_timestamp") >= days_before(as_of, days))
    return daily_order_volume(pre).orderBy(F.col("order_date").desc()).limit(limit)


def recent_order_events(order_events: DataFrame, limit: int = 100) -> DataFrame:
    """Newest ``limit`` rows of the order log (top-k, key as tiebreak)."""
    return order_events.orderBy(F.col("event_timestamp").desc(), F.col("order_id").desc(),
                                F.col("event_type")).limit(limit)
