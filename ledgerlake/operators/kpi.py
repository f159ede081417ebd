"""Dashboard reducers folded into the query: each KPI is one global aggregate
over a result set (partial aggregation on every task, one final row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MONEY_SUM


def kpi_sales_24h(hourly: DataFrame) -> DataFrame:
    """Revenue and orders of the window; mean of the hourly averages (which
    is not the overall average order value)."""
    return hourly.agg(
        F.coalesce(F.sum("total_revenue"), F.lit(0)).cast(MONEY_SUM).alias("revenue_24h"),
        F.coalesce(F.sum("total_orders"), F.lit(0)).cast("bigint").alias("orders_24h"),
        F.round(F.avg("avg_order_value"), 6).alias("mean_avg_order_value"),
        F.count(F.lit(1)).alias("n_hours"))


def kpi_inventory(snapshot: DataFrame) -> DataFrame:
    """Low-stock alert count (rows of the low-stock list) and SKU count."""
    return snapshot.agg(
        F.count_if(F.col("needs_reorder")).alias("low_stock_count"),
        F.count(F.lit(1)).alias("n_skus"))


def kpi_cashflow(overdue: DataFrame) -> DataFrame:
    """AR total, customers with a balance, oldest overdue age."""
    return overdue.agg(
        F.sum("total_outstanding").cast(MONEY_SUM).alias("ar_total"),
        F.count("customer_id").alias("overdue_customers"),
        F.max("days_overdue").alias("max_days_overdue"))


def kpi_daily_revenue(daily: DataFrame) -> DataFrame:
    """Legend of the daily revenue series: sum and mean."""
    return daily.agg(
        F.sum("total_revenue").cast(MONEY_SUM).alias("revenue_sum"),
        F.round(F.avg(F.col("total_revenue").cast("double")), 6).alias("revenue_mean"),
        F.count(F.lit(1)).alias("n_days"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: (table_name, row_count), as a union of counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def events_processed(decoded: DataFrame) -> DataFrame:
    """Size of the idempotency set: distinct event keys seen."""
    return decoded.agg(F.countDistinct("event_key").alias("events_processed"),
                       F.count(F.lit(1)).alias("messages_received"))
