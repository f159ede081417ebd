"""The analytics store: aggregate tables that are kept, and the named queries that read them.

``stock_snapshot`` and ``ar_aging`` are versioned tables (``sources.versioned``), refreshed
for the SKUs and customers that changed, or rebuilt as a whole into a new version; hourly
sales are kept by ``streaming.incremental``.  The named queries read the newest version
and nothing else: their cost is that of the aggregate, not of the history behind it.
The daily and the movement queries are views over the logs, as in ``plans.catalogue``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import receivables as ar
from ..functions.timefns import hours_before
from ..sources.versioned import VersionedTable
from ..streaming.incremental import HourlySales

#: Segments of tables with hashed keys: a refresh rewrites those of the changed keys.
SEGMENTS = 64
STOCK = ("sku string, product_name string, qty_on_hand int, reserved_qty int, available_qty int, reorder_point int, "
         "needs_reorder boolean, last_updated timestamp_ntz")
AGING = ("customer_id long, customer_name string, total_outstanding decimal(24,2), current_amount decimal(24,2), days_30 decimal(24,2), "
         "days_60 decimal(24,2), days_90_plus decimal(24,2), oldest_invoice_date date")


def _hashed(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SEGMENTS))


class AnalyticsStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.sales = HourlySales(spark, root)
        self.stock = VersionedTable(spark, f"{root}/stock_snapshot", STOCK, ["sku"], _hashed("sku"))
        self.aging = VersionedTable(spark, f"{root}/ar_aging", AGING, ["customer_id"], _hashed("customer_id"))

    # --- upkeep ----------------------------------------------------------------

    def refresh_stock(self, products: DataFrame, inventory_items: DataFrame, skus: DataFrame, **once) -> None:
        """Recompute the snapshot of ``skus`` (column sku); of those without a stock row it is deleted."""
        skus = skus.select("sku").distinct()
        rows = inv.stock_snapshot(products.join(skus, "sku", "left_semi"), inventory_items.join(skus, "sku", "left_semi"))
        self.stock.merge(rows, keys=skus, **once)

    def refresh_aging(self, customers: DataFrame, orders: DataFrame, invoices: DataFrame, ids: DataFrame, as_of, **once) -> None:
        """Recompute the balances of the customers ``ids`` (column customer_id); of those without an open invoice they are
        deleted.  The buckets depend on ``as_of``: another day needs ``rebuild_aging``."""
        ids = ids.select("customer_id").distinct()
        mine = orders.join(ids, "customer_id", "left_semi")
        theirs = invoices.join(mine.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        self.aging.merge(ar.ar_aging(theirs, mine, customers, as_of), keys=ids, **once)

    def rebuild_stock(self, products: DataFrame, inventory_items: DataFrame) -> None:
        self.stock.replace(inv.stock_snapshot(products, inventory_items))

    def rebuild_aging(self, customers: DataFrame, orders: DataFrame, invoices: DataFrame, as_of) -> None:
        self.aging.replace(ar.ar_aging(invoices, orders, customers, as_of))

    def rebuild(self, warehouse, as_of) -> None:
        """All stored aggregates from the whole tables and logs, each into a new version."""
        self.sales.rebuild(warehouse.order_events)
        self.rebuild_stock(warehouse.products, warehouse.inventory_items)
        self.rebuild_aging(warehouse.customers, warehouse.orders, warehouse.invoices, as_of)

    def vacuum(self, keep: int = 2) -> None:
        for table in (self.sales.customers, self.sales.hours, self.stock, self.aging):
            table.vacuum(keep)

    # --- named queries -----------------------------------------------------------

    def _recent(self, as_of, hours: int, limit: int) -> DataFrame:
        return self.sales.read().where(F.col("hour") >= hours_before(as_of, hours)).orderBy(F.col("hour").desc()).limit(limit)

    def query(self, name: str, limit: int = 100, *, as_of=None) -> DataFrame:
        """A named query over the stored tables, with the limits of the catalogue."""
        from .catalogue import MAX_LIMIT, MIN_LIMIT, QueryRejected
        queries = {
            "sales_24h": lambda: self._recent(as_of, 24, limit),
            "sales_7d": lambda: self._recent(as_of, 168, limit),
            "low_stock": lambda: inv.low_stock(self.stock.read(), limit),
            "overdue_ar": lambda: ar.overdue_ar(self.aging.read(), as_of, limit),
            "top_customers": lambda: ar.top_customers(self.aging.read(), limit),
        }
        if name not in queries:
            raise QueryRejected(f"Unknown query: {name}")
        if not MIN_LIMIT <= int(limit) <= MAX_LIMIT:
            raise QueryRejected(f"limit must be within {MIN_LIMIT}..{MAX_LIMIT}, got {limit}")
        return queries[name]()


# --- registered queries ---------------------------------------------------------

def _store(spark: SparkSession) -> AnalyticsStore:
    from ..session import scratch_path
    return AnalyticsStore(spark, scratch_path(spark, "store"))


def _stock_store(w) -> AnalyticsStore:
    """The snapshot as it was on 16 January (fewer SKUs, other quantities), then refreshed for what changed since."""
    store = _store(w.spark)
    changed = F.col("updated_at") >= F.lit("2024-01-16").cast("timestamp_ntz")
    before = (w.inventory_items.where(~changed | (F.col("sku").cast("long") % 7 != 0))
              .withColumn("qty_on_hand", F.when(changed, F.col("qty_on_hand") + 5).otherwise(F.col("qty_on_hand"))))
    store.rebuild_stock(w.products, before)
    store.refresh_stock(w.products, w.inventory_items, w.inventory_items.where(changed))
    return store


def _aging_store(w, as_of: str) -> AnalyticsStore:
    """The balances of what was invoiced before 2001, then refreshed for the customers invoiced since."""
    store = _store(w.spark)
    late = F.col("issued_at") >= F.lit("2001-01-01").cast("timestamp_ntz")
    store.rebuild_aging(w.customers, w.orders, w.invoices.where(~late), as_of)
    ids = w.orders.join(w.invoices.where(late).select(F.col("order_id").alias("id")), "id", "left_semi")
    store.refresh_aging(w.customers, w.orders, w.invoices, ids, as_of)
    return store


def _sales_store(w) -> AnalyticsStore:
    """Hourly sales from four batches of the event log, dealt by event id: every batch has events of all days."""
    store = _store(w.spark)
    for batch in range(4):
        store.sales.apply(w.order_events.where(F.col("id") % 4 == batch), "batches", batch)
    return store


def stored_queries(event_as_of: str, order_as_of: str) -> dict:
    """key -> function of a Warehouse."""

    def rebuilt(w) -> DataFrame:
        """A store of three days' events, rebuilt from the whole log."""
        store = _store(w.spark)
        store.sales.apply(w.order_events.where(F.col("event_timestamp") < F.lit("2024-01-04").cast("timestamp_ntz")), "batches", 0)
        store.sales.rebuild(w.order_events)
        return store.sales.read()

    return {
        "stored_sales_by_hour": lambda w: _sales_store(w).sales.read(),
        "stored_sales_7d": lambda w: _sales_store(w).query("sales_7d", as_of=event_as_of),
        "stored_stock_snapshot": lambda w: _stock_store(w).stock.read(),
        "stored_low_stock": lambda w: _stock_store(w).query("low_stock"),
        "stored_ar_aging": lambda w: _aging_store(w, order_as_of).aging.read(),
        "stored_overdue_ar": lambda w: _aging_store(w, order_as_of).query("overdue_ar", as_of=order_as_of),
        "stored_top_customers": lambda w: _aging_store(w, order_as_of).query("top_customers"),
        "rebuilt_sales_by_hour": rebuilt,
    }
