"""The named-query catalogue: a fixed set of parameterised queries, looked up
by name, with the limit validated (1..1000) before any plan is built."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import inventory as inv
from ..operators import receivables as ar
from ..operators import sales
from ..sources.tables import Warehouse

MIN_LIMIT, MAX_LIMIT, DEFAULT_LIMIT = 1, 1000, 100


@dataclass(frozen=True)
class NamedQuery:
    description: str
    build: Callable[[Warehouse, int, dict], DataFrame]


def _p(params: dict, key: str, default):
    return params.get(key, default)


# Query names and descriptions of the catalogue.
CATALOGUE: dict[str, NamedQuery] = {
    "sales_24h": NamedQuery(
        "Hourly sales for last 24 hours",
        lambda w, n, p: sales.sales_recent(w.order_events, _p(p, "as_of", "2024-01-31"), 24, n)),
    "sales_7d": NamedQuery(
        "Hourly sales for last 7 days",
        lambda w, n, p: sales.sales_recent(w.order_events, _p(p, "as_of", "2024-01-31"), 168, n)),
    "low_stock": NamedQuery(
        "Items that need reordering",
        lambda w, n, p: inv.low_stock(inv.stock_snapshot(w.products, w.inventory_items), n)),
    "overdue_ar": NamedQuery(
        "Customers with overdue invoices",
        lambda w, n, p: ar.overdue_ar(
            ar.ar_aging(w.invoices, w.orders, w.customers, _p(p, "as_of", "2001-08-02")),
            _p(p, "as_of", "2001-08-02"), n)),
    "daily_orders": NamedQuery(
        "Daily order volume and revenue",
        lambda w, n, p: sales.daily_orders(w.order_events, _p(p, "as_of", "2024-01-31"),
                                           int(_p(p, "days", 30)), n)),
    "stock_movement": NamedQuery(
        "Stock reservation summary by SKU",
        lambda w, n, p: inv.stock_movement(w.stock_events, n)),
    "top_customers": NamedQuery(
        "Top customers by outstanding AR",
        lambda w, n, p: ar.top_customers(
            ar.ar_aging(w.invoices, w.orders, w.customers, _p(p, "as_of", "2001-08-02")), n)),
    "revenue_by_day": NamedQuery(
        "Revenue aggregated by day",
        lambda w, n, p: sales.revenue_by_day(w.order_events, _p(p, "as_of", "2024-01-31"),
                                             int(_p(p, "days", 30)), n)),
}


class QueryRejected(ValueError):
    """Unknown query name or limit out of range."""


def list_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v.description) for k, v in CATALOGUE.items()],
                                 "name string, description string")


def run_query(spark: SparkSession, sf_dir: str, name: str, limit: int | None = DEFAULT_LIMIT,
              params: dict | None = None) -> DataFrame:
    """Build the named query.  ``limit`` defaults to 100 and must be 1..1000;
    unknown names are rejected.  Returns the DataFrame (columns via
    ``df.columns``, row count via ``df.count()`` on demand)."""
    if name not in CATALOGUE:
        raise QueryRejected(f"Unknown query: {name}")
    n = DEFAULT_LIMIT if limit is None else int(limit)
    if not MIN_LIMIT <= n <= MAX_LIMIT:
        raise QueryRejected(f"limit must be within {MIN_LIMIT}..{MAX_LIMIT}, got {n}")
    return CATALOGUE[name].build(Warehouse(spark, sf_dir), n, params or {})


def query_envelope(spark: SparkSession, sf_dir: str, name: str, limit: int | None = DEFAULT_LIMIT,
                   params: dict | None = None) -> dict:
    """The API result shape: name, column names, rows, row count and
    execution time.  Only the already limited result (at most 1000 rows)
    reaches the driver."""
    df = run_query(spark, sf_dir, name, limit, params)
    t0 = time.perf_counter()
    rows = [tuple(r) for r in df.collect()]
    return {"query_name": name, "columns": df.columns, "rows": rows, "row_count": len(rows),
            "execution_time_ms": round((time.perf_counter() - t0) * 1000, 2)}
