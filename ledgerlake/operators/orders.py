"""Orders: totals, flattened order details, current status, transitions.

Nested per-order arrays (``json_agg`` in the source view) are built in bounded chunks
(``nested_order_items``): a whole order's items would have to meet in one task and one
row, which does not hold when a single order may carry a large share of all lines.  The
detail is returned flattened, one row per item with its ordering columns
(``item_created_at``, ``line_number``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import left_join_hot_right
from ..schemas import ALLOWED_TRANSITIONS, MONEY, MONEY_SUM


def order_totals(order_items: DataFrame) -> DataFrame:
    """Per order: lines, quantity and total (sum of line totals)."""
    return order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("qty").cast("bigint").alias("total_qty"),
        F.sum("line_total").cast(MONEY_SUM).alias("order_total"))


def order_lines(order_items: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select("sku", F.col("name").alias("product_name"))
    return order_items.join(p, "sku", "left").select(
        "order_id", F.col("created_at").alias("item_created_at"), "line_number", "sku",
        "product_name", "qty", "line_total")


def order_details(orders: DataFrame, customers: DataFrame, order_items: DataFrame,
                  products: DataFrame) -> DataFrame:
    """Order header with customer name/email and each item (orders without
    items keep one row with NULL item columns)."""
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                         F.col("email").alias("customer_email"))
    header = orders.select(F.col("id").alias("order_id"), "customer_id", "status",
                           "total_amount", "created_at").join(c, "customer_id")
    return left_join_hot_right(header, order_lines(order_items, products), ["order_id"]).select(
        "order_id", "customer_id", "customer_name", "customer_email", "status", "total_amount",
        "created_at", "item_created_at", "line_number", "sku", "product_name", "qty", "line_total")


#: Items of a nested chunk at most.
CHUNK_ITEMS = 100


def nested_order_items(order_items: DataFrame, per_chunk: int = CHUNK_ITEMS) -> DataFrame:
    """An order's items as JSON arrays in order of their ``position`` (from 1), in chunks of ``per_chunk`` items.

    Positions come from the skew-safe running count, so the items of an order of any size are cut
    before anything is collected: a chunk bounds a row, and a hot order's chunks are spread."""
    from ..functions.prefix import grouped_prefix_sums
    order_cols = ["created_at", "line_number", "sku", "qty", "line_total"]
    lines = order_items.select("order_id", *order_cols, F.lit(1).cast("long").alias("one"))
    placed = grouped_prefix_sums(lines, ["order_id"], order_cols, ["one"])
    item = F.struct((F.col("one_before") + 1).cast("int").alias("position"), "sku", "qty", "line_total")
    chunks = (placed.groupBy("order_id", F.floor(F.col("one_before") / per_chunk).cast("int").alias("chunk"))
              .agg(F.array_sort(F.collect_list(item)).alias("items")))
    return chunks.select("order_id", "chunk", F.size("items").alias("n_items"), F.to_json("items").alias("items"))


def order_by_id(orders: DataFrame, order_items: DataFrame, order_id) -> DataFrame:
    """Point lookup of one order with its items; the key filter is pushed into
    both scans (Parquet min/max statistics skip row groups)."""
    o = orders.filter(F.col("id") == F.lit(order_id)).select(
        F.col("id").alias("order_id"), "customer_id", "status", "total_amount", "created_at")
    items = order_items.filter(F.col("order_id") == F.lit(order_id)).select(
        "order_id", "line_number", "sku", "qty", "line_total")
    return o.join(items, "order_id", "left")


def orders_with_items(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """One-to-many load: every order with its items (orders without items keep one row)."""
    parents = orders.select(F.col("id").alias("order_id"), "customer_id", "status", "total_amount", "created_at")
    children = order_items.select("order_id", "line_number", "sku", "qty", "line_total")
    return left_join_hot_right(parents, children, ["order_id"])


def price_order_items(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Price each line from the catalogue (0 when the SKU is unknown)."""
    p = products.select("sku", F.col("price").alias("catalog_price"))
    unit = F.coalesce(F.col("catalog_price"), F.lit(0).cast("decimal(12,2)"))
    return order_items.select("order_id", "line_number", "sku", "qty").join(p, "sku", "left").select(
        "order_id", "line_number", "sku", "qty", unit.alias("unit_price"),
        (F.col("qty") * unit).cast(MONEY).alias("line_total"),
        F.col("catalog_price").isNotNull().alias("known_sku"))


def price_known_items(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Price the lines whose SKU is in the catalogue; the others drop out."""
    return price_order_items(order_items, products).filter("known_sku").drop("known_sku")


def order_current_status(history: DataFrame) -> DataFrame:
    """Latest status per order (highest sequence), as a partial aggregate that
    combines map-side.  The status is carried as its number: aggregates over
    fixed-width values stay hash aggregates, without a sort before the shuffle."""
    known = sorted({s for pair in ALLOWED_TRANSITIONS for s in pair})
    names = F.array(*[F.lit(s) for s in known])
    return (history.filter(F.col("status").isin(*known))
            .select("order_id", "seq", "ts", F.array_position(names, F.col("status")).cast("int").alias("code"))
            .groupBy("order_id")
            .agg(F.max_by("code", "seq").alias("code"), F.max_by("ts", "seq").alias("changed_at"),
                 F.count(F.lit(1)).alias("n_changes"))
            .select("order_id", F.element_at(names, F.col("code")).alias("current_status"), "changed_at", "n_changes"))


def status_transitions(history: DataFrame) -> DataFrame:
    """Consecutive status pairs per order by joining step n to step n-1 on the
    unique key (order_id, seq): a 1:1 equi-join, no window over the order."""
    prev = history.select("order_id", (F.col("seq") + 1).alias("seq"),
                          F.col("status").alias("from_status"))
    cur = history.select("order_id", "seq", F.col("status").alias("to_status"), "ts")
    return cur.join(prev, ["order_id", "seq"]).select(
        "order_id", "seq", "from_status", "to_status", "ts")


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Transitions not in the fixed allowed set (5 pairs, broadcast)."""
    spark = history.sparkSession
    allowed = spark.createDataFrame(list(ALLOWED_TRANSITIONS), "from_status string, to_status string")
    return status_transitions(history).join(
        F.broadcast(allowed), ["from_status", "to_status"], "left_anti").select(
        "order_id", "seq", "from_status", "to_status", "ts")


def order_status_breakdown(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("total_amount").cast(MONEY_SUM).alias("total_amount"))
