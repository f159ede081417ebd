"""Inventory: status views, stock snapshot, low-stock lists, movement summary.

Products and inventory rows are joined on ``sku``; the planner picks a
broadcast hash join only when a side's statistics are under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime), else a
sort-merge join on the key.  Nothing here forces a broadcast because the
catalogue grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import STOCK_BANDS, band_below


def inventory_status(products: DataFrame, inventory_items: DataFrame) -> DataFrame:
    """Every product with its stock; a product without stock row counts as
    zeros and keeps a NULL ``updated_at``."""
    i = inventory_items.select("sku", "qty_on_hand", "reserved_qty", "reorder_point", "updated_at")
    j = products.select("sku", "name", "description", "price").join(i, "sku", "left")
    on_hand = F.coalesce(F.col("qty_on_hand"), F.lit(0))
    reserved = F.coalesce(F.col("reserved_qty"), F.lit(0))
    reorder = F.coalesce(F.col("reorder_point"), F.lit(0))
    return j.select(
        "sku", "name", "description", "price",
        on_hand.alias("qty_on_hand"), reserved.alias("reserved_qty"),
        (on_hand - reserved).alias("available_qty"), reorder.alias("reorder_point"),
        (on_hand - reserved <= reorder).alias("needs_reorder"),
        "updated_at")


def product_by_sku(products: DataFrame, inventory_items: DataFrame, sku: str) -> DataFrame:
    """Point lookup of one product with its stock; the key is pushed into both scans."""
    return inventory_status(products.filter(F.col("sku") == F.lit(sku)), inventory_items.filter(F.col("sku") == F.lit(sku)))


def with_stock_flags(df: DataFrame) -> DataFrame:
    """``available_qty = on_hand - reserved``; ``needs_reorder`` inclusive."""
    return df.withColumns({
        "available_qty": F.col("qty_on_hand") - F.col("reserved_qty"),
        "needs_reorder": (F.col("qty_on_hand") - F.col("reserved_qty")) <= F.col("reorder_point"),
    })


def stock_snapshot(products: DataFrame, inventory_items: DataFrame) -> DataFrame:
    """Per stocked SKU: name, on hand, reserved, available, reorder point and
    flag (the aggregate table of the analytics store)."""
    p = products.select("sku", F.col("name").alias("product_name"))
    base = inventory_items.join(p, "sku", "left")
    return with_stock_flags(base).select(
        "sku", "product_name", "qty_on_hand", "reserved_qty", "available_qty",
        "reorder_point", "needs_reorder", F.col("updated_at").alias("last_updated"))


def low_stock(snapshot: DataFrame, limit: int = 100) -> DataFrame:
    """Items needing reorder, most urgent (least available) first."""
    return (snapshot.filter(F.col("needs_reorder"))
            .select("sku", "product_name", "qty_on_hand", "reserved_qty", "available_qty",
                    "reorder_point", "last_updated")
            .orderBy(F.col("available_qty").asc_nulls_last(), F.col("sku")).limit(limit))


def inventory_listed(products: DataFrame, inventory_items: DataFrame) -> DataFrame:
    """Only products that have a stock row (inner join)."""
    p = products.select("sku", "name", "price")
    j = inventory_items.select("sku", "qty_on_hand", "reserved_qty", "reorder_point").join(p, "sku")
    on_hand = F.coalesce(F.col("qty_on_hand"), F.lit(0))
    reserved = F.coalesce(F.col("reserved_qty"), F.lit(0))
    return j.select("sku", "name", "price", "qty_on_hand", "reserved_qty",
                    (on_hand - reserved).alias("available_qty"), "reorder_point")


def low_stock_fixed(listed: DataFrame, threshold: int = 10) -> DataFrame:
    """Low stock with one constant threshold regardless of product."""
    return listed.filter(F.col("available_qty") <= threshold)


def inventory_search(listed: DataFrame, term: str, low_only: bool = False,
                     threshold: int = 10) -> DataFrame:
    """Case-insensitive substring search on SKU or product name."""
    t = F.lower(F.lit(term))
    hit = F.lower(F.col("sku")).contains(t) | F.coalesce(F.lower(F.col("name")).contains(t), F.lit(False))
    out = listed.filter(hit)
    return low_stock_fixed(out, threshold) if low_only else out


def stock_bands(listed: DataFrame) -> DataFrame:
    """Traffic-light band of available stock (< 10 red, < 20 yellow)."""
    return listed.select("sku", "available_qty",
                         band_below(F.col("available_qty"), STOCK_BANDS, "green").alias("band"))


def stock_movement_summary(stock_events: DataFrame) -> DataFrame:
    """Per SKU over ``stock_reserved`` events: count, quantity, first/last."""
    return (stock_events.filter(F.col("event_type") == "stock_reserved")
            .groupBy("sku")
            .agg(F.count(F.lit(1)).alias("total_reservations"),
                 F.sum("qty_reserved").cast("bigint").alias("total_qty_reserved"),
                 F.min("event_timestamp").alias("first_reservation"),
                 F.max("event_timestamp").alias("last_reservation")))


def stock_movement(stock_events: DataFrame, limit: int | None = 100) -> DataFrame:
    """Top SKUs by reserved quantity (top-k; SKU as tiebreak); all of them without a ``limit``."""
    out = stock_movement_summary(stock_events)
    if limit is None:
        return out
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be within 1..1000")
    return (out
            .orderBy(F.col("total_qty_reserved").desc_nulls_last(), F.col("sku")).limit(limit))


def top_reserved_skus(stock_events: DataFrame, limit: int = 20) -> DataFrame:
    """The panel's top SKUs: 1 to 500 of them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    return stock_movement(stock_events, limit)


def repair_quantities(inventory_items: DataFrame) -> DataFrame:
    """Rewrite NULL on-hand / reserved quantities to 0."""
    return inventory_items.na.fill(0, subset=["qty_on_hand", "reserved_qty"])


def stock_totals(inventory_items: DataFrame) -> DataFrame:
    return inventory_items.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("qty_on_hand").cast("bigint").alias("total_on_hand"),
        F.sum("reserved_qty").cast("bigint").alias("total_reserved"))


def inventory_summary(listed: DataFrame, threshold: int = 10) -> DataFrame:
    """Rows, low-stock count (constant threshold) and total on hand."""
    return listed.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("available_qty") <= threshold).alias("low_stock_items"),
        F.sum("qty_on_hand").cast("bigint").alias("total_on_hand"))
