"""Hourly sales kept up incrementally: a micro-batch adds to stored state.

The state of an hour is its sums (orders, revenue, newest event) and its set of
customers (``operators.distinct_sets``).  Both are versioned tables: a batch
aggregates its own rows, reads the state of the hours it touches, and commits new
versions of their segments.  The raw log is never read again, whatever its size, and late
events of any age are just rows of their hour.

The batch id is committed with each version, so a batch that is processed again after a
crash, between the two commits too, changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import safe_div
from ..functions.timefns import trunc_ntz
from ..operators.distinct_sets import SET_COLUMNS, id_sets, merged_sets, set_sizes
from ..schemas import MONEY_SUM
from ..sources.versioned import VersionedTable

HOURLY = ("hour timestamp_ntz, total_orders long, total_revenue decimal(24,2), avg_order_value double, "
          "unique_customers long, updated_at timestamp_ntz")


class HourlySales:
    """The stored ``sales_by_hour`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        # A day's customer sets are a segment; the hours themselves are few rows, a month of them is one.
        self.customers = VersionedTable(spark, f"{root}/hour_customers", f"hour timestamp_ntz, {SET_COLUMNS}", ["hour", "bucket", "member"], F.to_date("hour"))
        self.hours = VersionedTable(spark, f"{root}/sales_by_hour", HOURLY, ["hour"], F.date_format("hour", "yyyy-MM"))

    @staticmethod
    def _sums(created: DataFrame) -> DataFrame:
        return created.groupBy("hour").agg(
            F.count(F.lit(1)).alias("total_orders"), F.sum("total_amount").cast(MONEY_SUM).alias("total_revenue"), F.max("event_timestamp").alias("updated_at"))

    def _with_customers(self, sums: DataFrame, sets: DataFrame) -> DataFrame:
        sizes = set_sizes(sets, ["hour"], "unique_customers")
        return sums.join(sizes, "hour", "left").select(
            "hour", "total_orders", "total_revenue", safe_div(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
            F.coalesce("unique_customers", F.lit(0)).cast("long").alias("unique_customers"), "updated_at")

    @staticmethod
    def _created(order_events: DataFrame) -> DataFrame:
        return order_events.where("event_type = 'order_created'").select(
            trunc_ntz("hour", F.col("event_timestamp")).alias("hour"), "customer_id", "total_amount", "event_timestamp")

    def apply(self, order_events: DataFrame, app: str, batch: int) -> None:
        """Add a batch of (already deduplicated) order events; a batch id that was applied is skipped."""
        created = self._created(order_events)
        self.customers.merge(id_sets(created, ["hour"], "customer_id"), lambda old, new: merged_sets(old, new, ["hour"]),
                             keys=created.select("hour"), app=app, batch=batch)
        sets = self.customers.version()

        def add(old: DataFrame, new: DataFrame) -> DataFrame:
            hours = new.select("hour")
            names = ["hour", "total_orders", "total_revenue", "updated_at"]
            both = old.join(hours, "hour", "left_semi").select(*names).unionByName(new.select(*names))
            sums = both.groupBy("hour").agg(F.sum("total_orders").alias("total_orders"), F.sum("total_revenue").cast(MONEY_SUM).alias("total_revenue"),
                                            F.max("updated_at").alias("updated_at"))
            mine = self.customers.read(sets, self.customers.touched(hours)).join(hours, "hour", "left_semi")
            return old.join(hours, "hour", "left_anti").unionByName(self._with_customers(sums, mine))

        self.hours.merge(self._sums(created), add, app=app, batch=batch)

    def rebuild(self, order_events: DataFrame) -> None:
        """Both tables anew from a whole log, as new versions: readers change over at the commit of each.
        What batches were applied stays known."""
        created = self._created(order_events)
        sets = self.customers.replace(id_sets(created, ["hour"], "customer_id"))
        self.hours.replace(self._with_customers(self._sums(created), self.customers.read(sets)))

    def read(self) -> DataFrame:
        return self.hours.read()
