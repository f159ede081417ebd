"""Table scans and the binding of the test tables onto the business model.

Every model table is a pure projection/filter (or one equi-join) over the
source parquet, so Catalyst prunes columns and pushes filters into the scans.
The same expressions are written as SQL in ``plans.oracle`` for the DuckDB
cross-check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY, PRICE

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def days_after(ts: Column, n) -> Column:
    """TIMESTAMP_NTZ + n days (n a column or int)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.timestamp_add("DAY", n_col, ts)


# --- binding functions: source DataFrame(s) -> model DataFrame -------------

def bind_customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("customer"), F.col("c_custkey").cast("string"),
                 F.lit("@example.com")).alias("email"),
        F.col("c_nationkey").alias("nation_key"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("metadata"),
    )


def bind_products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").cast(PRICE).alias("price"),
        F.col("p_brand").alias("brand"),
    )


def bind_inventory_items(part: DataFrame) -> DataFrame:
    on_hand = ((F.col("p_partkey") * 37) % 200).cast("int")
    return (part.filter(F.col("p_partkey") % 10 != 9)
            .select(
                F.col("p_partkey").cast("string").alias("sku"),
                on_hand.alias("qty_on_hand"),
                ((F.col("p_partkey") * 13) % (on_hand + 1)).cast("int").alias("reserved_qty"),
                F.col("p_size").alias("reorder_point"),
                days_after(F.lit("2024-01-01").cast("timestamp_ntz"),
                           (F.col("p_partkey") % 30).cast("int")).alias("updated_at"),
            ))


def order_status_expr(orderkey: Column, orderstatus: Column) -> Column:
    return (F.when(orderkey % 17 == 0, "cancelled")
            .when(orderstatus == "F", "completed")
            .when(orderstatus == "O", "placed")
            .otherwise("draft"))


def bind_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        order_status_expr(F.col("o_orderkey"), F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("priority"),
    )


def bind_order_items(lineitem: DataFrame) -> DataFrame:
    """Order lines.  ``(order_id, line_number)`` is NOT unique in the test
    data; item order is (created_at, line_number, sku, qty, line_total)."""
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).cast(PRICE).alias("price"),
        F.col("l_extendedprice").cast(MONEY).alias("line_total"),
        F.col("l_shipdate").alias("created_at"),
    )


def bind_order_status_history(orders: DataFrame) -> DataFrame:
    """Status history per order, generated row-locally (no grouping):
    draft at the order date; placed +1 d unless P; shipped +2 d and completed
    +3 d if F; cancelled +2 d if key % 17 = 0 (instead of shipped/completed);
    one illegal draft->shipped step (+1 d) if key % 23 = 0 and status P."""
    k, s, d = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    cancelled = k % 17 == 0

    def step(cond: Column, status: str, days: int) -> Column:
        return F.when(cond, F.struct(F.lit(status).alias("status"),
                                     days_after(d, days).alias("ts")))

    steps = F.array_compact(F.array(
        step(F.lit(True), "draft", 0),
        step((s == "P") & (k % 23 == 0), "shipped", 1),
        step(s != "P", "placed", 1),
        step(cancelled, "cancelled", 2),
        step(~cancelled & (s == "F"), "shipped", 2),
        step(~cancelled & (s == "F"), "completed", 3),
    ))
    return (orders.select(k.alias("order_id"), F.posexplode(steps).alias("pos", "st"))
            .select("order_id", "st.status", "st.ts", (F.col("pos") + 1).alias("seq")))


def bind_invoices(orders_model: DataFrame) -> DataFrame:
    """One already-issued invoice per non-draft order; id = order id."""
    status = (F.when(F.col("status") == "completed", "paid")
              .when(F.col("status") == "placed", "issued")
              .otherwise(F.col("status")))
    return (orders_model.filter(F.col("status") != "draft")
            .select(
                F.col("id").alias("id"),
                F.col("id").alias("order_id"),
                F.col("total_amount").alias("amount"),
                status.alias("status"),
                F.col("created_at").alias("issued_at"),
                F.date_add(F.to_date("created_at"), 30).alias("due_date"),
                F.when(status == "paid", days_after(F.col("created_at"), 3))
                 .cast("timestamp_ntz").alias("paid_at"),
            ))


def bind_order_events(events: DataFrame) -> DataFrame:
    """purchase -> order_created, click -> order_updated.  Written as a union
    of one filtered projection per type: a filter on the mapped type then
    prunes the other branch and reaches the scan as ``event_type = ...``."""
    def branch(raw: str, mapped: str, status) -> DataFrame:
        return events.filter(F.col("event_type") == raw).select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("order_id"),
            F.lit(mapped).alias("event_type"),
            F.col("user_id").alias("customer_id"),
            F.col("value").cast(MONEY).alias("total_amount"),
            F.lit(status).cast("string").alias("status"),
            F.col("ts").alias("event_timestamp"),
        )
    return branch("purchase", "order_created", "placed").unionByName(
        branch("click", "order_updated", None))


def bind_stock_events(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One stock_reserved event per order line, stamped with the order date.
    Both sides are large: a shuffle (sort-merge) join on the order key."""
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return (lineitem.select("l_orderkey", "l_partkey", "l_quantity")
            .join(o, "l_orderkey")
            .select(
                F.lit("stock_reserved").alias("event_type"),
                F.col("l_partkey").cast("string").alias("sku"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_quantity").cast("int").alias("qty_reserved"),
                F.col("o_orderdate").alias("event_timestamp"),
            ))


def bind_events_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type"),
        F.lit("test").alias("source"),
        F.col("props").alias("payload"),
        F.col("ts").alias("recorded_at"),
    )


# Faulty variants (FIXTURES.md section 2): what checks, repairs and lookups of unknown keys have to find.

def with_null_quantities(inventory_items: DataFrame) -> DataFrame:
    k = F.col("sku").cast("long")
    return (inventory_items.withColumn("qty_on_hand", F.when(k % 40 != 3, F.col("qty_on_hand")))
            .withColumn("reserved_qty", F.when(k % 40 != 5, F.col("reserved_qty"))))


def with_repeated_emails(customers: DataFrame) -> DataFrame:
    return customers.withColumn("email", F.when(F.col("id") % 100 == 1, F.lit("customer1@example.com")).otherwise(F.col("email")))


def with_unknown_keys(order_items: DataFrame) -> DataFrame:
    """Lines of unknown SKUs and of unknown orders."""
    return (order_items.withColumn("sku", F.when(F.col("sku").cast("long") % 50 == 8, F.concat(F.lit("X"), F.col("sku"))).otherwise(F.col("sku")))
            .withColumn("order_id", F.when(F.col("order_id") % 100 == 1, -F.col("order_id")).otherwise(F.col("order_id"))))


def with_public_ids(customers: DataFrame) -> DataFrame:
    """Customers with a public id in UUID form, of which some are cut short."""
    h = F.md5(F.col("id").cast("string").cast("binary"))
    whole = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return customers.withColumn("public_id", F.when(F.col("id") % 50 == 7, F.substring(whole, 1, 30)).otherwise(whole))


def with_missing_postings(ledger_entries: DataFrame) -> DataFrame:
    return ledger_entries.filter((F.col("account") != "revenue") | (F.col("ref_id") % 1000 != 3))


class Warehouse:
    """Lazily bound model tables over one test-data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def customers(self) -> DataFrame:
        return bind_customers(self.raw("customer"))

    @cached_property
    def products(self) -> DataFrame:
        return bind_products(self.raw("part"))

    @cached_property
    def inventory_items(self) -> DataFrame:
        return bind_inventory_items(self.raw("part"))

    @cached_property
    def orders(self) -> DataFrame:
        return bind_orders(self.raw("orders"))

    @cached_property
    def order_items(self) -> DataFrame:
        return bind_order_items(self.raw("lineitem"))

    @cached_property
    def order_status_history(self) -> DataFrame:
        return bind_order_status_history(self.raw("orders"))

    @cached_property
    def invoices(self) -> DataFrame:
        return bind_invoices(self.orders)

    @cached_property
    def order_events(self) -> DataFrame:
        return bind_order_events(self.raw("events"))

    @cached_property
    def stock_events(self) -> DataFrame:
        return bind_stock_events(self.raw("lineitem"), self.raw("orders"))

    @cached_property
    def events_log(self) -> DataFrame:
        return bind_events_log(self.raw("events"))

    @cached_property
    def ledger_entries(self) -> DataFrame:
        from ..operators.ledger import post_invoices
        return post_invoices(self.invoices)
