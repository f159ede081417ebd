"""Event messages: emit (to JSON), decode (from JSON with defaults), route.

A message is ``(subject STRING, data STRING)``; ``subject`` is
``orders.<event_type>``.  Decoding uses ``from_json`` with the fixed payload
schema, so it runs JVM-side and works identically on batch and streaming
DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT_PAYLOAD, EVENT_TYPES, ITEMS_PER_MESSAGE, SUBJECT_PREFIX

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_TS)


def emit(df: DataFrame, event_type: Column | str, payload: dict[str, Column], beside: dict[str, Column] | None = None) -> DataFrame:
    """Wrap rows as messages: subject ``orders.<type>``, JSON ``data``; columns ``beside`` them are for whoever hands them out."""
    et = F.lit(event_type) if isinstance(event_type, str) else event_type
    fields = [et.alias("event_type")] + [c.alias(k) for k, c in payload.items()]
    return df.select(F.concat(F.lit(SUBJECT_PREFIX), et).alias("subject"),
                     F.to_json(F.struct(*fields)).alias("data"), *[c.alias(k) for k, c in (beside or {}).items()])


def emit_order_events(order_events: DataFrame) -> DataFrame:
    """order_created / order_updated messages from the order log shape."""
    return emit(order_events, F.col("event_type"), {
        "event_id": F.col("id").cast("string"),
        "order_id": F.col("order_id"),
        "customer_id": F.col("customer_id"),
        "status": F.col("status"),
        "total_amount": F.col("total_amount"),
        "timestamp": iso(F.col("event_timestamp")),
    })


def emit_stock_events(stock_events: DataFrame) -> DataFrame:
    return emit(stock_events, F.col("event_type"), {
        "order_id": F.col("order_id"),
        "sku": F.col("sku"),
        "qty": F.col("qty_reserved"),
        "timestamp": iso(F.col("event_timestamp")),
    })


def emit_invoice_events(invoices: DataFrame) -> DataFrame:
    return emit(invoices, "invoice_created", {
        "event_id": F.concat(F.lit("inv-"), F.col("id").cast("string")),
        "invoice_id": F.col("id"),
        "order_id": F.col("order_id"),
        "amount": F.col("amount"),
        "status": F.col("status"),
        "due_date": F.col("due_date").cast("string"),
        "timestamp": iso(F.col("issued_at")),
    })


def emit_raw_events(events: DataFrame) -> DataFrame:
    """Every row of the raw ``events`` table as a message: purchase ->
    order_created, click -> order_updated, other types keep their name (and
    are unknown to the router)."""
    et = (F.when(F.col("event_type") == "purchase", "order_created")
          .when(F.col("event_type") == "click", "order_updated")
          .otherwise(F.col("event_type")))
    return emit(events, et, {
        "event_id": F.col("event_id").cast("string"),
        "order_id": F.col("event_id"),
        "customer_id": F.col("user_id"),
        "status": F.when(F.col("event_type") == "purchase", "placed"),
        "total_amount": F.col("value").cast("decimal(14,2)"),
        "timestamp": iso(F.col("ts")),
    })


def event_key(subject: Column, p: Column, compat: bool = False) -> Column:
    """Idempotency key: the payload ``event_id``; when absent, subject +
    order id (+ sku + timestamp unless ``compat``, which reproduces the
    coarser fallback ``subject:order_id``)."""
    if compat:
        fallback = F.concat_ws(":", subject, F.coalesce(p["order_id"].cast("string"), F.lit("unknown")))
    else:
        fallback = F.concat_ws(":", subject, F.coalesce(p["order_id"].cast("string"), F.lit("unknown")),
                               F.coalesce(p["sku"], F.lit("")),
                               F.coalesce(p["timestamp"], p["created_at"], F.lit("")))
    return F.coalesce(p["event_id"], fallback)


def decode_events(raw: DataFrame, compat_key: bool = False) -> DataFrame:
    """Parse ``data`` and apply the per-type defaults: missing amounts and
    quantities -> 0, created status -> placed, invoice status -> issued,
    failure reason -> insufficient_stock; ``qty_reserved`` falls back to
    ``qty``; the event time is ``timestamp`` else ``created_at``.
    ``is_valid`` is FALSE for unparseable JSON or a missing/invalid time."""
    p = F.from_json(F.col("data"), EVENT_PAYLOAD,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # The parse is fenced by a one-row generator: a later filter on a decoded
    # field (validity, type) cannot be pushed below it, which would otherwise
    # inline ``from_json`` into the filter and parse every message twice.
    parsed = raw.select("subject", "data", F.explode(F.array(p)).alias("p"))
    bad = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull()
    et = F.regexp_replace(F.col("subject"), "^" + SUBJECT_PREFIX.replace(".", r"\."), "")
    pp = F.col("p")
    zero_money = F.lit(0).cast("decimal(14,2)")
    # As an instant first: an offset in the text is converted to UTC, not dropped.
    ts = F.coalesce(pp["timestamp"], pp["created_at"]).try_cast("timestamp").cast("timestamp_ntz")
    out = parsed.select(
        "subject", "data",
        et.alias("event_type"),
        F.when(bad, F.concat(F.lit("raw:"), F.sha2(F.col("data"), 256)))
         .otherwise(event_key(F.col("subject"), pp, compat_key)).alias("event_key"),
        pp["event_id"].alias("event_id"),
        pp["order_id"].alias("order_id"),
        pp["customer_id"].alias("customer_id"),
        F.when(et == "order_created", F.coalesce(pp["status"], F.lit("placed")))
         .when(et == "invoice_created", F.coalesce(pp["status"], F.lit("issued")))
         .otherwise(pp["status"]).alias("status"),
        F.coalesce(pp["total_amount"], zero_money).alias("total_amount"),
        F.coalesce(pp["part"], F.lit(0)).alias("part"),
        F.coalesce(pp["parts"], F.lit(1)).alias("parts"),
        pp["items"].alias("items"),
        pp["sku"].alias("sku"),
        F.coalesce(pp["qty_reserved"], pp["qty"], F.lit(0)).alias("qty_reserved"),
        F.when(et == "reservation_failed", F.coalesce(pp["reason"], pp["error"], F.lit("insufficient_stock")))
         .alias("reason"),
        pp["invoice_id"].alias("invoice_id"),
        F.coalesce(pp["amount"], zero_money).alias("amount"),
        pp["due_date"].try_cast("date").alias("due_date"),
        ts.alias("event_timestamp"),
        (~bad & ts.isNotNull()).alias("is_valid"),
    )
    return out


def route(decoded: DataFrame) -> dict[str, DataFrame]:
    """Subject -> handler branch; unknown subjects go to ``skipped``."""
    branches = {t: decoded.filter(F.col("event_type") == t) for t in EVENT_TYPES}
    branches["skipped"] = decoded.filter(~F.col("event_type").isin(*EVENT_TYPES))
    return branches


def route_counts(decoded: DataFrame) -> DataFrame:
    """Messages per handler; unknown subjects are acknowledged and counted
    as ``skipped``."""
    handler = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("skipped")
    return decoded.groupBy(handler.alias("handler")).agg(F.count(F.lit(1)).alias("messages"))


def explode_items(decoded: DataFrame) -> DataFrame:
    """One row per item of ``order_created`` payloads.  The item position is
    the payload's ``position`` when present, else its index in the message."""
    return items_of(decoded.filter(F.col("is_valid") & (F.col("event_type") == "order_created")))


def items_of(created: DataFrame) -> DataFrame:
    return (created
            .select("order_id", "event_timestamp", F.posexplode("items").alias("idx", "item"))
            .select("order_id", "event_timestamp",
                    F.coalesce(F.col("item.position"), F.col("idx") + 1).alias("position"),
                    F.col("item.sku").alias("sku"), F.col("item.qty").alias("qty"),
                    F.col("item.price").alias("price"), F.col("item.line_total").alias("line_total")))


_ITEMS_TYPE = ("array<struct<id:string,position:int,sku:string,qty:int,"
               "line_total:decimal(14,2),created_at:string>>")


def emit_orders_with_items(orders: DataFrame, order_items: DataFrame,
                           per_message: int = ITEMS_PER_MESSAGE, beside: dict[str, Column] | None = None,
                           scratch: str | None = None) -> DataFrame:
    """``order_created`` messages with their items.  Lines are numbered per
    order with the skew-safe running count and cut into parts of at most
    ``per_message`` items, so neither a message nor a grouping task grows
    with the size of one order.  Orders without lines send one empty part.
    ``beside`` are columns of (order_id, part, parts, created_at) that go with the messages, so that
    nobody has to parse them again.  ``scratch`` is a path for the numbered lines, which the caller removes once
    the messages are written."""
    from ..functions.prefix import grouped_prefix_sums, partitions_for
    from ..session import drop_shuffles
    order_cols = ["created_at", "line_number", "sku", "qty", "line_total"]
    lines = order_items.select("order_id", *order_cols, F.lit(1).cast("long").alias("one"))
    numbered = grouped_prefix_sums(lines, ["order_id"], order_cols, ["one"], num_partitions=partitions_for(lines), scratch=scratch)
    drop_shuffles(orders.sparkSession)
    item = F.struct(
        F.concat_ws("-", F.col("order_id").cast("string"), (F.col("one_before") + 1).cast("string")).alias("id"),
        (F.col("one_before") + 1).cast("int").alias("position"), "sku", "qty", "line_total",
        iso(F.col("created_at")).alias("created_at"))
    parts = (numbered.withColumn("part", F.floor(F.col("one_before") / per_message).cast("long"))
             .groupBy("order_id", "part").agg(F.array_sort(F.collect_list(item)).alias("items")))
    # Lines are numbered without gaps, so the last number tells how many parts there are.
    counts = numbered.groupBy("order_id").agg((F.floor(F.max("one_before") / per_message) + 1).cast("int").alias("parts"))
    header = orders.select(F.col("id").alias("order_id"), "customer_id", "status", "total_amount",
                           "created_at").join(counts, "order_id", "left")
    # An inner join for orders with lines: a side with a very long order can be split there.
    empty = header.where("parts IS NULL").withColumns({"part": F.lit(0), "items": F.array().cast(_ITEMS_TYPE), "parts": F.lit(1)})
    msgs = header.where("parts IS NOT NULL").join(parts.withColumn("part", F.col("part").cast("int")), "order_id").unionByName(empty)
    return emit(msgs, "order_created", {
        "event_id": F.concat_ws("-", F.col("order_id").cast("string"), F.col("part").cast("string")),
        "order_id": F.col("order_id"),
        "customer_id": F.col("customer_id"),
        "status": F.col("status"),
        "total_amount": F.col("total_amount"),
        "part": F.col("part"),
        "parts": F.col("parts"),
        "items": F.col("items"),
        "timestamp": iso(F.col("created_at")),
    }, beside)


# --- log shapes (what is appended to each event log) -----------------------

def order_log_rows(decoded: DataFrame) -> DataFrame:
    """Order events; an order sent in several parts counts once, by its first."""
    return (decoded.filter(F.col("is_valid") & F.col("event_type").isin("order_created", "order_updated") & (F.col("part") == 0))
            .select("event_key", "order_id", "event_type", "customer_id", "total_amount", "status",
                    "event_timestamp", F.to_date("event_timestamp").alias("event_date")))


def stock_log_rows(decoded: DataFrame) -> DataFrame:
    qty = F.when(F.col("event_type") == "reservation_failed", F.lit(0)).otherwise(F.col("qty_reserved"))
    return (decoded.filter(F.col("is_valid") & F.col("event_type").isin("stock_reserved", "reservation_failed"))
            .select("event_key", "event_type", "sku", "order_id", qty.cast("int").alias("qty_reserved"),
                    "event_timestamp", F.to_date("event_timestamp").alias("event_date")))


def invoice_log_rows(decoded: DataFrame) -> DataFrame:
    return (decoded.filter(F.col("is_valid") & (F.col("event_type") == "invoice_created"))
            .select("event_key", "invoice_id", "order_id", "event_type", "amount", "status", "due_date",
                    "event_timestamp", F.to_date("event_timestamp").alias("event_date")))


def quarantine_rows(decoded: DataFrame) -> DataFrame:
    """Poison messages: kept with a reason instead of being retried forever."""
    reason = F.when(F.col("event_timestamp").isNull() & F.col("order_id").isNotNull(), "bad_timestamp") \
        .otherwise("malformed_json")
    return decoded.filter(~F.col("is_valid")).select("subject", "data", reason.alias("reason"))
