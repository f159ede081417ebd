"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key of the inventory.  Each reads the whole test tables through the
model binding; parameters are the documented defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import inventory as inv
from ..operators import audit, kpi, ledger, orders, quality, receivables as ar, sales, upsert
from ..session import ensure_session_conf
from ..sources import events as ev
from ..sources import tables
from ..sources.tables import Warehouse
from .stored import stored_queries

# Fixed evaluation instants of the test data: events span January 2024, orders
# 1995-01-01 .. 2001-08-01.
EVENT_AS_OF = "2024-01-31"
ORDER_AS_OF = "2001-08-02"
DEFAULT_LIMIT = 100
LOOKUP_ORDER_ID = 7
LOOKUP_INVOICE_ID = 7
LOOKUP_SKU = "7"
SEARCH_TERM = "blue"
AUDIT_EVENT_TYPE = "error"

Query = Callable[[SparkSession, str], DataFrame]


def _wh(spark: SparkSession, sf_dir: str) -> Warehouse:
    ensure_session_conf(spark)
    return Warehouse(spark, sf_dir)


def _q(fn: Callable[[Warehouse], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_wh(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def _aging(w: Warehouse) -> DataFrame:
    return ar.ar_aging(w.invoices, w.orders, w.customers, ORDER_AS_OF)


def _balances(w: Warehouse) -> DataFrame:
    return ar.ar_balances(w.invoices, w.orders, ORDER_AS_OF)


def _snapshot(w: Warehouse) -> DataFrame:
    return inv.stock_snapshot(w.products, w.inventory_items)


def _listed(w: Warehouse) -> DataFrame:
    return inv.inventory_listed(w.products, w.inventory_items)


def _model_tables(w: Warehouse) -> dict[str, DataFrame]:
    return {"customers": w.customers, "products": w.products,
            "inventory_items": w.inventory_items, "orders": w.orders,
            "order_items": w.order_items, "invoices": w.invoices,
            "ledger_entries": w.ledger_entries}


def _faulty_tables(w: Warehouse) -> dict[str, DataFrame]:
    return _model_tables(w) | {
        "customers": tables.with_repeated_emails(w.customers), "inventory_items": tables.with_null_quantities(w.inventory_items),
        "order_items": tables.with_unknown_keys(w.order_items), "ledger_entries": tables.with_missing_postings(w.ledger_entries)}


def _sales_upsert(w: Warehouse) -> DataFrame:
    """Touched-hour refresh as an upsert: version 1 = rollup of the events
    before Jan 20; version 2 = rollup recomputed from Jan 15 on.  Hours of the
    overlap are replaced by the newer, complete version."""
    from pyspark.sql import functions as F
    e = w.order_events
    old = sales.sales_by_hour(e.filter(F.col("event_timestamp") < F.lit("2024-01-20").cast("timestamp_ntz")))
    new = sales.sales_by_hour(e.filter(F.col("event_timestamp") >= F.lit("2024-01-15").cast("timestamp_ntz")))
    return upsert.upsert_latest(old.withColumn("version", F.lit(1)),
                                new.withColumn("version", F.lit(2)), ["hour"], "version").drop("version")


def _seed_hours(w: Warehouse) -> DataFrame:
    """Rows inserted if absent into the hourly rollup: one hour that it has, two that it lacks."""
    from pyspark.sql import functions as F
    base = sales.sales_by_hour(w.order_events)
    seed = w.spark.createDataFrame(
        [(2, 11, "1210.00", 110.0, 10), (-20000, 4, "50.00", 12.5, 4), (-20001, 6, "99.00", 16.5, 1)],
        "h int, total_orders long, total_revenue string, avg_order_value double, unique_customers long")
    seed = seed.select(
        F.timestamp_add("HOUR", -F.col("h"), F.lit(EVENT_AS_OF).cast("timestamp_ntz")).alias("hour"),
        "total_orders", F.col("total_revenue").cast("decimal(24,2)").alias("total_revenue"),
        "avg_order_value", "unique_customers",
        F.lit(EVENT_AS_OF).cast("timestamp_ntz").alias("updated_at"))
    return upsert.insert_if_absent(seed, base, ["hour"])


def _decoded_raw(w: Warehouse) -> DataFrame:
    return ev.decode_events(ev.emit_raw_events(w.raw("events")))


def _redelivered(w: Warehouse) -> DataFrame:
    """Every message delivered twice (at-least-once redelivery)."""
    raw = ev.emit_raw_events(w.raw("events"))
    return ev.decode_events(raw.unionByName(raw))


def _dedup(w: Warehouse) -> DataFrame:
    d = _redelivered(w).dropDuplicates(["event_key"])
    return ev.order_log_rows(d).drop("event_key", "event_date")


QUERIES: dict[str, Query] = {
    # --- sales family ---------------------------------------------------
    "sales_by_hour": _q(lambda w: sales.sales_by_hour(w.order_events)),
    "sales_24h": _q(lambda w: sales.sales_recent(w.order_events, EVENT_AS_OF, 24, DEFAULT_LIMIT)),
    "sales_7d": _q(lambda w: sales.sales_recent(w.order_events, EVENT_AS_OF, 168, DEFAULT_LIMIT)),
    "sales_hourly": _q(lambda w: sales.sales_hourly(w.order_events, EVENT_AS_OF, 72)),
    "daily_order_volume": _q(lambda w: sales.daily_order_volume(w.order_events)),
    "daily_orders": _q(lambda w: sales.daily_orders(w.order_events, EVENT_AS_OF, 30, DEFAULT_LIMIT)),
    "revenue_by_day": _q(lambda w: sales.revenue_by_day(w.order_events, EVENT_AS_OF, 30, DEFAULT_LIMIT)),
    "recent_order_events": _q(lambda w: sales.recent_order_events(w.order_events, DEFAULT_LIMIT)),
    # --- inventory family -------------------------------------------------
    "inventory_status": _q(lambda w: inv.inventory_status(w.products, w.inventory_items)),
    "stock_snapshot": _q(_snapshot),
    "low_stock": _q(lambda w: inv.low_stock(_snapshot(w), DEFAULT_LIMIT)),
    "inventory_listed": _q(_listed),
    "low_stock_fixed": _q(lambda w: inv.low_stock_fixed(_listed(w), 10)),
    "inventory_search": _q(lambda w: inv.inventory_search(_listed(w), SEARCH_TERM)),
    "stock_bands": _q(lambda w: inv.stock_bands(_listed(w))),
    "stock_movement_summary": _q(lambda w: inv.stock_movement_summary(w.stock_events)),
    "stock_movement": _q(lambda w: inv.stock_movement(w.stock_events, DEFAULT_LIMIT)),
    "top_reserved_skus": _q(lambda w: inv.top_reserved_skus(w.stock_events, 20)),
    "product_by_sku": _q(lambda w: inv.product_by_sku(w.products, w.inventory_items, LOOKUP_SKU)),
    "repair_quantities": _q(lambda w: inv.repair_quantities(tables.with_null_quantities(w.inventory_items))),
    "stock_totals": _q(lambda w: inv.stock_totals(w.inventory_items)),
    "inventory_summary": _q(lambda w: inv.inventory_summary(_listed(w), 10)),
    "kpi_inventory": _q(lambda w: kpi.kpi_inventory(_snapshot(w))),
    # --- billing / receivables -------------------------------------------
    "generate_invoices": _q(lambda w: ledger.generate_invoices(w.orders, w.invoices, ORDER_AS_OF)),
    "invoice_details": _q(lambda w: ar.invoice_details(w.invoices, w.orders, w.customers, ORDER_AS_OF)),
    "invoice_by_id": _q(lambda w: ar.invoice_by_id(w.invoices, LOOKUP_INVOICE_ID)),
    "invoice_overdue_flag": _q(lambda w: ar.invoice_overdue_flag(w.invoices, ORDER_AS_OF)),
    "invoices_by_status": _q(lambda w: ar.invoices_by_status(w.invoices, ORDER_AS_OF, "overdue")),
    "invoice_facets": _q(lambda w: ar.invoice_facets(w.invoices, ORDER_AS_OF)),
    "invoice_summary": _q(lambda w: ar.invoice_summary(w.invoices, ORDER_AS_OF, "all")),
    "ar_aging": _q(_aging),
    "overdue_ar": _q(lambda w: ar.overdue_ar(_aging(w), ORDER_AS_OF, DEFAULT_LIMIT)),
    "top_customers": _q(lambda w: ar.top_customers(_aging(w), DEFAULT_LIMIT)),
    "ar_bucket_distribution": _q(lambda w: ar.ar_bucket_distribution(_balances(w))),
    "overdue_ar_totals": _q(lambda w: ar.overdue_ar_totals(ar.overdue_ar_all(_balances(w), ORDER_AS_OF))),
    "severity_bands": _q(lambda w: ar.severity_bands(ar.overdue_ar_all(_balances(w), ORDER_AS_OF))),
    "kpi_cashflow": _q(lambda w: kpi.kpi_cashflow(ar.overdue_ar_all(_balances(w), ORDER_AS_OF))),
    "ledger_entries": _q(lambda w: w.ledger_entries),
    "account_balances": _q(lambda w: ledger.account_balances(w.ledger_entries)),
    "ledger_balanced": _q(lambda w: ledger.ledger_unbalanced(tables.with_missing_postings(w.ledger_entries))),
    "trial_balance": _q(lambda w: ledger.trial_balance(w.ledger_entries)),
    # --- orders ------------------------------------------------------------
    "order_totals": _q(lambda w: orders.order_totals(w.order_items)),
    "order_details": _q(lambda w: orders.order_details(w.orders, w.customers, w.order_items, w.products)),
    "order_by_id": _q(lambda w: orders.order_by_id(w.orders, w.order_items, LOOKUP_ORDER_ID)),
    "nested_order_items": _q(lambda w: orders.nested_order_items(w.order_items, 3)),
    "orders_with_items": _q(lambda w: orders.orders_with_items(w.orders, w.order_items)),
    "price_order_items": _q(lambda w: orders.price_order_items(tables.with_unknown_keys(w.order_items), w.products)),
    "price_known_items": _q(lambda w: orders.price_known_items(tables.with_unknown_keys(w.order_items), w.products)),
    "order_current_status": _q(lambda w: orders.order_current_status(w.order_status_history)),
    "illegal_transitions": _q(lambda w: orders.illegal_transitions(w.order_status_history)),
    "order_status_breakdown": _q(lambda w: orders.order_status_breakdown(w.orders)),
    # --- KPIs and tables ------------------------------------------------------
    "kpi_sales_24h": _q(lambda w: kpi.kpi_sales_24h(sales.sales_hourly(w.order_events, EVENT_AS_OF, 24))),
    "kpi_daily_revenue": _q(lambda w: kpi.kpi_daily_revenue(
        sales.daily_orders(w.order_events, EVENT_AS_OF, 30, None))),
    "table_counts": _q(lambda w: kpi.table_counts(_model_tables(w))),
    "quality_violations": _q(lambda w: quality.quality_violations(_faulty_tables(w))),
    "orphans": _q(lambda w: quality.orphans(w.customers, w.products, w.inventory_items, w.orders,
                                            tables.with_unknown_keys(w.order_items), w.invoices)),
    "valid_order_items": _q(lambda w: quality.valid_references(
        tables.with_unknown_keys(w.order_items), {"order_id": (w.orders, "id"), "sku": (w.products, "sku")})
        .select("order_id", "line_number", "sku", "qty", "line_total")),
    "orders_without_items": _q(lambda w: quality.orders_without_items(w.orders, tables.with_unknown_keys(w.order_items))),
    "uuid_violations": _q(lambda w: quality.violations(tables.with_public_ids(w.customers), [quality.uuid_rule("public_id")], "id")
                          .select("row_key")),
    "upsert_latest": _q(_sales_upsert),
    "insert_if_absent": _q(_seed_hours),
    "audit_events": _q(lambda w: audit.audit_events(w.events_log, AUDIT_EVENT_TYPE)),
    "format_display": _q(lambda w: audit.format_display(w.orders, w.customers)),
    "format_datetime_display": _q(lambda w: audit.format_datetime_display(w.orders)),
    # --- events: emit / decode / route / log / dedup ---------------------------
    "emit_events": _q(lambda w: ev.emit_order_events(w.order_events)),
    "decode_events": _q(lambda w: ev.order_log_rows(_decoded_raw(w)).drop("event_key", "event_date")),
    "route_events": _q(lambda w: ev.route_counts(_decoded_raw(w))),
    "order_event_log": _q(lambda w: ev.order_log_rows(ev.decode_events(ev.emit_order_events(w.order_events)))),
    "stock_event_log": _q(lambda w: ev.stock_log_rows(ev.decode_events(ev.emit_stock_events(w.stock_events)))
                          .drop("event_key")),
    "invoice_event_log": _q(lambda w: ev.invoice_log_rows(ev.decode_events(ev.emit_invoice_events(w.invoices)))),
    "dedup_events": _q(_dedup),
    "events_processed": _q(lambda w: kpi.events_processed(_redelivered(w))),
}


def queries() -> dict[str, Query]:
    out = dict(QUERIES)
    out.update({k: _q(fn) for k, fn in stored_queries(EVENT_AS_OF, ORDER_AS_OF).items()})
    from . import extra
    out.update(extra.EXTRA_QUERIES)
    return out
