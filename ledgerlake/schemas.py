"""Explicit schemas of the data model (nothing is inferred).

Money is DECIMAL(14,2) (prices DECIMAL(12,2)); timestamps are TIMESTAMP_NTZ
holding UTC wall-clock time, exactly as in the source parquet files.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
PRICE = T.DecimalType(12, 2)
# Sums of money widen to DECIMAL(24,2) so totals never overflow.
MONEY_SUM = T.DecimalType(24, 2)
TS = T.TimestampNTZType()

# Fixed values of the domain (must equal the reference system's enums).
ORDER_STATUSES = ("draft", "placed", "cancelled", "shipped", "completed")
INVOICE_STATUSES = ("issued", "paid", "overdue", "cancelled")
LEDGER_REF_TYPES = ("order", "invoice", "payment", "payroll", "adjustment")
# Allowed order status transitions (from -> to).
ALLOWED_TRANSITIONS = (
    ("draft", "placed"),
    ("draft", "cancelled"),
    ("placed", "shipped"),
    ("placed", "cancelled"),
    ("shipped", "completed"),
)
# Event subjects of the stream and the event type each carries.
SUBJECT_PREFIX = "orders."
EVENT_TYPES = ("order_created", "order_updated", "stock_reserved",
               "reservation_failed", "invoice_created")
PAYMENT_TERMS_DAYS = 30
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Raw stream record: one message per row.
RAW_EVENT = T.StructType([
    T.StructField("subject", T.StringType(), False),
    T.StructField("data", T.StringType(), True),
])

ORDER_ITEM_PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("sku", T.StringType()),
    T.StructField("qty", T.IntegerType()),
    T.StructField("price", PRICE),
    T.StructField("line_total", MONEY),
    T.StructField("created_at", T.StringType()),
])
# An order_created message carries at most this many items; larger orders
# are sent as several parts (event ids "<order>-<part>", fields ``part`` and
# ``parts``): an order is counted by its first part and reserved when all are there.
ITEMS_PER_MESSAGE = 100

# Union of all payload fields; absent fields decode to NULL and are then
# defaulted per event type (see sources.events.decode_events).
EVENT_PAYLOAD = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_amount", MONEY),
    T.StructField("part", T.IntegerType()),
    T.StructField("parts", T.IntegerType()),
    T.StructField("items", T.ArrayType(ORDER_ITEM_PAYLOAD)),
    T.StructField("sku", T.StringType()),
    T.StructField("qty", T.IntegerType()),
    T.StructField("qty_reserved", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("invoice_id", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("due_date", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

ORDER_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("order_id", T.LongType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("customer_id", T.LongType()),
    T.StructField("total_amount", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("event_timestamp", TS, False),
])

INVOICE_EVENTS = T.StructType([
    T.StructField("invoice_id", T.LongType(), False),
    T.StructField("order_id", T.LongType()),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("amount", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("event_timestamp", TS, False),
])

STOCK_EVENTS = T.StructType([
    T.StructField("event_type", T.StringType(), False),
    T.StructField("sku", T.StringType(), False),
    T.StructField("order_id", T.LongType()),
    T.StructField("qty_reserved", T.IntegerType()),
    T.StructField("event_timestamp", TS, False),
])

SALES_BY_HOUR = T.StructType([
    T.StructField("hour", TS, False),
    T.StructField("total_orders", T.LongType()),
    T.StructField("total_revenue", MONEY_SUM),
    T.StructField("avg_order_value", T.DoubleType()),
    T.StructField("unique_customers", T.LongType()),
    T.StructField("updated_at", TS),
])

STOCK_SNAPSHOT = T.StructType([
    T.StructField("sku", T.StringType(), False),
    T.StructField("product_name", T.StringType()),
    T.StructField("qty_on_hand", T.IntegerType()),
    T.StructField("reserved_qty", T.IntegerType()),
    T.StructField("available_qty", T.IntegerType()),
    T.StructField("reorder_point", T.IntegerType()),
    T.StructField("needs_reorder", T.BooleanType()),
    T.StructField("last_updated", TS),
])
