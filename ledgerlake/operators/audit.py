"""Audit log filtering with JSON payload extraction, and display formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import format_currency, format_date, format_datetime, format_number, truncate


def audit_events(events_log: DataFrame, event_type: str) -> DataFrame:
    """Audit rows of one type with the payload's ``k`` field extracted
    (equality filter on ``event_type`` reaches the Parquet scan)."""
    return (events_log.filter(F.col("event_type") == event_type)
            .select("id", "event_type", "source", "recorded_at",
                    F.get_json_object("payload", "$.k").cast("int").alias("payload_k")))


def format_datetime_display(orders: DataFrame) -> DataFrame:
    """Creation time and total as the tables of the user interface show them."""
    return orders.select(F.col("id").alias("order_id"), format_datetime(F.col("created_at")).alias("datetime_display"),
                         format_number(F.col("total_amount")).alias("number_display"))


def format_display(orders: DataFrame, customers: DataFrame, name_width: int = 12) -> DataFrame:
    """Orders as shown in the UI: currency, medium date, truncated name."""
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    return orders.join(c, "customer_id", "left").select(
        F.col("id").alias("order_id"),
        format_currency(F.col("total_amount")).alias("amount_display"),
        format_date(F.col("created_at")).alias("date_display"),
        truncate(F.col("customer_name"), name_width).alias("customer_display"))
