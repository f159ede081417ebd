"""Registered queries that run the streaming and the iterative operators.

Streaming keys emit the ``events`` table as JSON messages (every message
delivered twice, as at-least-once redelivery would), drop them as files
under the shared checkpoint folder, run the ingest job with
``availableNow`` in several micro-batches and return the table it wrote.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import grouped_prefix_sums, partitions_for
from ..operators import reservation as rsv
from ..session import drop_folder, drop_shuffles, ensure_session_conf, move_folder, scratch_path, shuffle_partitions
from ..sources import events as ev
from ..sources.event_log import EventLog
from ..sources.tables import Warehouse
from ..operators import sales
from ..sources.sinks import export_csv, read_csv
from ..streaming.late import WindowedSales
from ..streaming.reservations import ReservationConsumer
from ..streaming.ingest import IngestJob, dedup_stream, read_event_stream, write_messages

#: Micro-batches that the registered streams cut their input files into.
MICRO_BATCHES = 3


def _files_per_batch(spark: SparkSession, inbox: str) -> int:
    return max(1, -(-len(spark.read.text(inbox).inputFiles()) // MICRO_BATCHES))


def _messages(w: Warehouse, poison: bool = False) -> DataFrame:
    raw = ev.emit_raw_events(w.raw("events"))
    if poison:
        # 'error' events arrive as truncated, undecodable payloads.
        raw = raw.withColumn("data", F.when(F.col("subject") == "orders.error",
                                            F.expr("substring(data, 1, length(data) DIV 2)"))
                             .otherwise(F.col("data")))
    return raw.unionByName(raw)


def _run_stream(spark: SparkSession, sf_dir: str, poison: bool = False, billing: bool = False) -> IngestJob:
    """The analytics consumer, or (``billing``) the billing consumer with
    per-order idempotency kept in the stream's state."""
    ensure_session_conf(spark)
    w = Warehouse(spark, sf_dir)
    root = scratch_path(spark, "ingest")
    write_messages(_messages(w, poison), f"{root}/inbox")
    if billing:
        job = IngestJob(spark, store=f"{root}/store", checkpoint=f"{root}/checkpoint", analytics=False,
                        billing=True, idempotency="order")
    else:
        job = IngestJob(spark, store=f"{root}/store", checkpoint=f"{root}/checkpoint")
    job.run_available(read_event_stream(spark, f"{root}/inbox", _files_per_batch(spark, f"{root}/inbox")))
    return job


def stream_sales_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _run_stream(spark, sf_dir)
    return spark.read.parquet(job.paths["sales_by_hour"]).drop("sales_date")


def stream_order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _run_stream(spark, sf_dir)
    return spark.read.parquet(job.paths["order_events"]).drop("batch_id")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _run_stream(spark, sf_dir, poison=True)
    return spark.read.parquet(job.paths["quarantine"]).select("subject", "reason")


def stream_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _run_stream(spark, sf_dir, billing=True)
    return spark.read.parquet(job.paths["invoices"]).drop("batch_id")


def stream_ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _run_stream(spark, sf_dir, billing=True)
    return spark.read.parquet(job.paths["ledger_entries"]).drop("batch_id")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event source -> decode -> dedup -> the exactly-once streaming file
    sink (no foreachBatch), read back through the sink's metadata log."""
    ensure_session_conf(spark)
    w = Warehouse(spark, sf_dir)
    root = scratch_path(spark, "events")
    write_messages(_messages(w), f"{root}/inbox")
    decoded = dedup_stream(ev.decode_events(read_event_stream(spark, f"{root}/inbox", _files_per_batch(spark, f"{root}/inbox"))))
    q = (decoded.select("subject", "event_key", "order_id", "customer_id", "total_amount", "event_timestamp")
         .writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def explode_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_created messages with items (parts of at most 100 items) ->
    decode -> one row per item."""
    w = _wh(spark, sf_dir)
    msgs = ev.emit_orders_with_items(w.orders, w.order_items)
    return ev.explode_items(ev.decode_events(msgs)).select("order_id", "position", "sku", "qty", "line_total")


def stream_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_created messages with items -> stream -> stock reservation in
    foreachBatch, all in one micro-batch, so that orders are decided in order of arrival over all
    (``stream_reservation_state`` carries its state over several)."""
    ensure_session_conf(spark)
    w = Warehouse(spark, sf_dir)
    root = scratch_path(spark, "reserve-stream")
    messages = ev.emit_orders_with_items(w.orders, w.order_items, scratch=f"{root}/numbered/lines")
    with shuffle_partitions(spark, partitions_for(w.order_items)):
        write_messages(messages, f"{root}/inbox", compression="gzip")
    drop_folder(spark, f"{root}/numbered")
    drop_shuffles(spark)
    job = IngestJob(spark, store=f"{root}/store", checkpoint=f"{root}/checkpoint", analytics=False,
                    inventory=w.inventory_items, rocksdb=True)
    job.run_available(read_event_stream(spark, f"{root}/inbox"))
    return spark.read.parquet(job.paths["reservations"]).select(
        "order_id", F.col("arrival").alias("created_at"), "reserved", "reason")


#: Drops of the stream whose consumer carries its state.
DROPS = 3


def _dropped_reservations(spark: SparkSession, sf_dir: str) -> ReservationConsumer:
    """Orders in parts of two lines come in ``DROPS`` drops in order of arrival, all parts but an order's last one
    drop early, and the consumer is started anew for each drop."""
    ensure_session_conf(spark)
    w = Warehouse(spark, sf_dir)
    root = scratch_path(spark, "reserve-state")
    arrival = F.unix_seconds(F.col("created_at").cast("timestamp"))
    first, last = w.raw("orders").agg(*[F.unix_seconds(f("o_orderdate").cast("timestamp")) for f in (F.min, F.max)]).first()
    early = F.col("part") < F.col("parts") - 1
    drop = F.floor((arrival - F.lit(first)) * DROPS / F.lit((last or 0) - (first or 0) + 1)).cast("int")
    # Dealt by columns beside the messages, whose text isn't parsed for it.  They are written once: a drop's folder is moved into the inbox as it comes.
    messages = ev.emit_orders_with_items(w.orders, w.order_items, per_message=2, beside={"drop": F.greatest(F.lit(0), F.when(early, drop - 1).otherwise(drop))},
                                         scratch=f"{root}/numbered/lines")
    with shuffle_partitions(spark, partitions_for(w.order_items)):
        messages.write.partitionBy("drop").option("compression", "gzip").json(f"{root}/messages")
    drop_folder(spark, f"{root}/numbered")
    drop_shuffles(spark)
    consumer = ReservationConsumer(spark, f"{root}/store", f"{root}/checkpoint", w.inventory_items)
    for k in range(DROPS):
        move_folder(spark, f"{root}/messages/drop={k}", f"{root}/inbox/{k}")
        consumer.run_available(read_event_stream(spark, f"{root}/inbox/*"))
    return consumer


def stream_reservation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the consumer that keeps compacted state, over several restarts."""
    consumer = _dropped_reservations(spark, sf_dir)
    return spark.read.parquet(consumer.paths["reservations"]).select("order_id", "created_at", "reserved", "reason")


def stream_reserved_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock that this consumer leaves behind: per SKU what is still available and what was reserved."""
    return _dropped_reservations(spark, sf_dir).stock.read().select("sku", (F.col("x0") - F.col("taken")).alias("available"), "taken")


def _event_drops(w: Warehouse, root: str, drops: int = 4):
    """The inbox after each drop of a share of the messages (by event id; each share has events of all days)."""
    for k in range(drops):
        write_messages(ev.emit_raw_events(w.raw("events").where(F.col("event_id") % drops == k)), f"{root}/inbox")
        yield f"{root}/inbox"


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watermark of two hours drops of a stream in four drops: a report row for each batch."""
    ensure_session_conf(spark)
    w = Warehouse(spark, sf_dir)
    root = scratch_path(spark, "late")
    job = WindowedSales(spark, f"{root}/store", f"{root}/checkpoint")
    for inbox in _event_drops(w, root):
        job.run_available(read_event_stream(spark, inbox))
    return job.report()


def _order_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """The order log in twelve batches, compacted along the way."""
    w = _wh(spark, sf_dir)
    rows = ev.order_log_rows(ev.decode_events(ev.emit_raw_events(w.raw("events")))).withColumn("k", F.pmod(F.xxhash64("event_key"), F.lit(12)))
    path = scratch_path(spark, "log-rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    log = EventLog(spark, scratch_path(spark, "order-log"), rows.drop("k").schema)
    for k in range(12):
        log.append(rows.where(F.col("k") == k).drop("k"), "drops", k, dt.datetime(2024, 2, 1, k))
        if k % 4 == 3:
            log.compact(2)
    return log


def logged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the log with its ids checked: per date the rows, and over all the least and most id and how many there are."""
    rows = _order_log(spark, sf_dir).read()
    ids = rows.agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.countDistinct("id").alias("ids"))
    return rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_amount").cast("decimal(24,2)").alias("total"),
                                          F.count("processed_at").alias("processed")).crossJoin(F.broadcast(ids))


def stored_product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SKU of the stored snapshot by its key: one segment is opened."""
    from .stored import _stock_store
    return _stock_store(_wh(spark, sf_dir)).stock.lookup(sku="7")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export the daily order volume as CSV with a header and read it back."""
    w = _wh(spark, sf_dir)
    df = sales.daily_order_volume(w.order_events)
    path = scratch_path(spark, "export") + "/daily_order_volume.csv"
    export_csv(df, path)
    return read_csv(spark, path, df.schema)


# --- iterative admission (rows-only: no SQL formulation) ----------------------

def _wh(spark, sf_dir):
    ensure_session_conf(spark)
    return Warehouse(spark, sf_dir)


def reserve_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wh(spark, sf_dir)
    return rsv.reserve_orders(w.orders, w.order_items, w.inventory_items)


def reservation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wh(spark, sf_dir)
    return rsv.reservation_failures(rsv.reserve_orders(w.orders, w.order_items, w.inventory_items))


def reservation_failed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line at which each rejected order failed, with what was available."""
    w = _wh(spark, sf_dir)
    path = scratch_path(spark, "decisions")
    rsv.reserve_orders(w.orders, w.order_items, w.inventory_items).write.parquet(path)
    stock = w.inventory_items.select("sku", (F.col("qty_on_hand") - F.col("reserved_qty")).cast("long").alias("x0"))
    return rsv.failing_lines(rsv.with_positions(w.order_items), spark.read.parquet(path), stock)


def _line_requests(w: Warehouse) -> DataFrame:
    """Every lineitem row as one request.  Its id is the order's key and the line's
    place in the order, padded so that text order is number order: it depends on
    neither file splits nor partitions."""
    place = ["l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    li = w.raw("lineitem").select("l_orderkey", *place, F.lit(1).cast("long").alias("one"))
    li = grouped_prefix_sums(li, ["l_orderkey"], place, ["one"], num_partitions=partitions_for(li))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    o = w.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return li.withColumn("line_id", F.concat_ws("-", pad(F.col("l_orderkey"), 12), pad(F.col("one_before") + 1, 6))).join(o, "l_orderkey")


def reserve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a reservation of its own, in (order date, order, line) order."""
    w = _wh(spark, sf_dir)
    req = _line_requests(w).select(
        F.col("line_id").alias("request_id"), F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_quantity").cast("long").alias("qty"), F.col("o_orderdate").alias("ts"))
    return rsv.reserve_lines(req, w.inventory_items, partitions=partitions_for(w.order_items)).drop("round")


def adjust_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines restock (+qty), other lines ship out (-qty), in ship-date order."""
    w = _wh(spark, sf_dir)
    adj = _line_requests(w).select(
        F.col("line_id").alias("adj_id"), F.col("l_partkey").cast("string").alias("sku"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
         .cast("long").alias("delta"),
        F.col("l_shipdate").alias("ts"))
    return rsv.adjust_stock(adj, w.inventory_items, partitions=partitions_for(w.order_items)).drop("round")


def release_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled orders release their lines' quantities from reserved stock."""
    w = _wh(spark, sf_dir)
    cancelled = w.orders.filter(F.col("status") == "cancelled").select(
        F.col("id").alias("order_id"), F.timestamp_add("DAY", F.lit(2), F.col("created_at")).alias("ts"))
    rel = (_line_requests(w).select(F.col("l_orderkey").alias("order_id"), "line_id",
                                     F.col("l_partkey").cast("string").alias("sku"),
                                     F.col("l_quantity").cast("long").alias("qty"))
           .join(cancelled, "order_id")
           .select(F.col("line_id").alias("release_id"), "sku", "qty", "ts"))
    return rsv.release_reservations(rel, w.inventory_items, partitions=partitions_for(w.order_items)).drop("round")


EXTRA_QUERIES = {
    "stream_sales_by_hour": stream_sales_by_hour,
    "stream_order_log": stream_order_log,
    "quarantine": quarantine,
    "stream_invoices": stream_invoices,
    "stream_ledger_entries": stream_ledger_entries,
    "stream_events": stream_events,
    "explode_order_items": explode_order_items,
    "csv_export": csv_export,
    "stream_late_rows": stream_late_rows,
    "logged_orders": logged_orders,
    "stored_product_lookup": stored_product_lookup,
    "reserve_orders": reserve_orders,
    "stream_reservations": stream_reservations,
    "reservation_failures": reservation_failures,
    "reservation_failed_lines": reservation_failed_lines,
    "stream_reservation_state": stream_reservation_state,
    "stream_reserved_stock": stream_reserved_stock,
    "reserve_lines": reserve_lines,
    "adjust_stock": adjust_stock,
    "release_reservations": release_reservations,
}

def _fold_sql(requests: str, state: str) -> str:
    """Sequential decisions per key, by recursion over a request's rank within its key.
    requests: (txn_id, key, delta, ts); state: (key, x0, floor)."""
    return f"""
        SELECT txn_id, ts, decision, reason FROM (
          WITH RECURSIVE line_ids AS (
            SELECT *, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(row_number() OVER (
                PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS VARCHAR), 6, '0') AS line_id
            FROM lineitem),
          req AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, txn_id) AS rn FROM ({requests}) r0),
          st AS ({state}),
          run AS (
            SELECT r.key, r.rn, r.txn_id, r.ts, st.floor, st.x0 + r.delta >= st.floor AS ok,
                   CASE WHEN st.x0 + r.delta >= st.floor THEN st.x0 + r.delta ELSE st.x0 END AS x
            FROM req r JOIN st ON st.key = r.key WHERE r.rn = 1
            UNION ALL
            SELECT r.key, r.rn, r.txn_id, r.ts, p.floor, p.x + r.delta >= p.floor,
                   CASE WHEN p.x + r.delta >= p.floor THEN p.x + r.delta ELSE p.x END
            FROM run p JOIN req r ON r.key = p.key AND r.rn = p.rn + 1)
          SELECT txn_id, ts, CASE WHEN ok THEN 'admitted' ELSE 'rejected' END AS decision,
                 CASE WHEN NOT ok THEN 'insufficient' END AS reason FROM run
          UNION ALL
          SELECT txn_id, ts, 'rejected', 'unknown_key' FROM req WHERE key NOT IN (SELECT key FROM st)) folded"""


#: All-or-nothing reservation by recursion over orders in order of arrival; the state is the list of available quantities.
#: ``bad`` is the first line that an order fails at, ``left`` what was available for it.
_ADMISSION = """
    WITH RECURSIVE stock AS (
      SELECT sku, row_number() OVER (ORDER BY sku) AS i, CAST(qty_on_hand - reserved_qty AS BIGINT) AS x FROM m_inventory),
    lines AS (
      SELECT o.id AS order_id, o.created_at, l.sku, CAST(l.qty AS BIGINT) AS qty, s.i,
             row_number() OVER (PARTITION BY o.id ORDER BY l.created_at, l.line_number, l.sku, l.qty, l.line_total) AS position
      FROM m_orders o JOIN m_order_items l ON l.order_id = o.id LEFT JOIN stock s ON s.sku = l.sku),
    own AS (
      SELECT *, CAST(coalesce(sum(qty) OVER (PARTITION BY order_id, sku ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier
      FROM lines),
    asked AS (
      SELECT order_id, created_at, row_number() OVER (ORDER BY created_at, order_id) AS n, bool_or(i IS NULL) AS unknown,
             list({'position': position, 'sku': sku, 'qty': qty, 'i': i, 'earlier': earlier} ORDER BY position) AS ls
      FROM own GROUP BY order_id, created_at),
    run AS (
      SELECT CAST(0 AS BIGINT) AS n, (SELECT list(x ORDER BY i) FROM stock) AS x,
             CAST(NULL AS STRUCT("position" BIGINT, sku VARCHAR, qty BIGINT, i BIGINT, earlier BIGINT)) AS bad, CAST(NULL AS BIGINT) AS left_over
      UNION ALL
      SELECT n, CASE WHEN bad IS NULL THEN list_reduce(ls, lambda acc, l: acc[:l.i - 1] || [acc[l.i] - l.qty] || acc[l.i + 1:], x) ELSE x END,
             bad, x[bad.i] - bad.earlier
      FROM (SELECT a.n, r.x, a.ls, list_filter(a.ls, lambda l: l.i IS NULL OR r.x[l.i] - l.earlier < l.qty)[1] AS bad
            FROM run r JOIN asked a ON a.n = r.n + 1) step),
    decided AS (
      SELECT o.id AS order_id, o.created_at, run.bad IS NULL AS reserved,
             CASE WHEN run.bad IS NOT NULL THEN CASE WHEN a.unknown THEN 'unknown_sku' ELSE 'insufficient_stock' END END AS reason, run.bad, run.left_over
      FROM m_orders o LEFT JOIN asked a ON a.order_id = o.id LEFT JOIN run ON run.n = a.n)"""


def _admission(select: str) -> str:
    return f"SELECT * FROM ({_ADMISSION}\n{select}) admission"


EXTRA_SQL = {
    "stream_late_rows": """
        WITH e AS (SELECT event_id % 4 AS batch, ts FROM events WHERE event_type = 'purchase'),
        newest AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) AS newest FROM e GROUP BY batch),
        marks AS (SELECT batch, lag(newest) OVER (ORDER BY batch) - INTERVAL 120 MINUTE AS watermark FROM newest)
        SELECT CAST(batch AS INTEGER) AS batch_id, watermark,
               count(*) FILTER (WHERE watermark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > watermark) AS in_time,
               count(*) FILTER (WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= watermark) AS dropped
        FROM e JOIN marks USING (batch) GROUP BY batch, watermark""",
    "logged_orders": """
        SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS n_rows, CAST(sum(total_amount) AS DECIMAL(24,2)) AS total, count(*) AS processed,
               CAST(1 AS BIGINT) AS least_id, (SELECT count(*) FROM m_order_events) AS most_id, (SELECT count(*) FROM m_order_events) AS ids
        FROM m_order_events GROUP BY 1""",
    "stored_product_lookup": "SELECT * FROM d_snap WHERE sku = '7'",
    "reserve_orders": _admission("SELECT order_id, created_at, reserved, reason FROM decided"),
    "stream_reservations": _admission("SELECT CAST(order_id AS VARCHAR) AS order_id, created_at, reserved, reason FROM decided"),
    "stream_reservation_state": _admission("SELECT CAST(order_id AS VARCHAR) AS order_id, created_at, reserved, reason FROM decided"),
    "reservation_failures": _admission("""
        SELECT 'orders.reservation_failed' AS subject,
               '{"event_type":"reservation_failed","event_id":"rf-' || order_id || '","order_id":' || order_id || ',"reason":"' || reason
               || '","timestamp":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS data
        FROM decided WHERE NOT reserved"""),
    "reservation_failed_lines": _admission("""
        SELECT order_id, created_at, CAST(bad.position AS INTEGER) AS position, bad.sku AS sku, bad.qty AS qty, left_over AS available,
               CASE WHEN bad.i IS NULL THEN 'unknown_sku' ELSE 'insufficient_stock' END AS reason,
               CASE WHEN bad.i IS NULL THEN 'Product ' || bad.sku || ' not found in inventory'
                    ELSE 'Insufficient stock for ' || bad.sku || '. Available: ' || left_over || ', Requested: ' || bad.qty END AS error
        FROM decided WHERE NOT reserved"""),
    "stream_reserved_stock": _admission("""
        SELECT s.sku, s.x - coalesce(t.qty, 0) AS available, CAST(coalesce(t.qty, 0) AS BIGINT) AS taken
        FROM stock s LEFT JOIN (SELECT sku, sum(l.qty) AS qty FROM lines l JOIN decided d ON d.order_id = l.order_id AND d.reserved GROUP BY sku) t USING (sku)"""),
    "reserve_lines": _fold_sql(
        """SELECT l.line_id AS txn_id, CAST(l.l_partkey AS VARCHAR) AS key, -CAST(l.l_quantity AS BIGINT) AS delta, o.o_orderdate AS ts
           FROM line_ids l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
        "SELECT sku AS key, CAST(qty_on_hand - reserved_qty AS BIGINT) AS x0, 0 AS floor FROM m_inventory"),
    "adjust_stock": _fold_sql(
        """SELECT l.line_id AS txn_id, CAST(l.l_partkey AS VARCHAR) AS key,
                  CAST(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE -l.l_quantity END AS BIGINT) AS delta, l.l_shipdate AS ts
           FROM line_ids l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
        "SELECT sku AS key, CAST(qty_on_hand AS BIGINT) AS x0, greatest(0, reserved_qty) AS floor FROM m_inventory"),
    "release_reservations": _fold_sql(
        """SELECT l.line_id AS txn_id, CAST(l.l_partkey AS VARCHAR) AS key, -CAST(l.l_quantity AS BIGINT) AS delta,
                  o.created_at + INTERVAL 2 DAY AS ts
           FROM line_ids l JOIN m_orders o ON o.id = l.l_orderkey WHERE o.status = 'cancelled'""",
        "SELECT sku AS key, CAST(reserved_qty AS BIGINT) AS x0, 0 AS floor FROM m_inventory"),
    "csv_export": "SELECT * FROM d_dov",
    "stream_events": """
        SELECT 'orders.' || CASE event_type WHEN 'purchase' THEN 'order_created'
                                            WHEN 'click' THEN 'order_updated' ELSE event_type END AS subject,
               CAST(event_id AS VARCHAR) AS event_key, CAST(event_id AS VARCHAR) AS order_id, CAST(user_id AS VARCHAR) AS customer_id,
               CAST(value AS DECIMAL(14,2)) AS total_amount, ts AS event_timestamp
        FROM events""",
    "explode_order_items": """
        SELECT CAST(order_id AS VARCHAR) AS order_id,
               CAST(row_number() OVER (PARTITION BY order_id
                                       ORDER BY created_at, line_number, sku, qty, line_total) AS INTEGER)
                 AS position,
               sku, qty, line_total
        FROM m_order_items""",
    "stream_sales_by_hour": "SELECT * FROM d_sbh",
    "stream_order_log": """
        SELECT CAST(id AS VARCHAR) AS event_key, CAST(order_id AS VARCHAR) AS order_id, event_type,
               CAST(customer_id AS VARCHAR) AS customer_id, total_amount, status,
               event_timestamp, CAST(event_timestamp AS DATE) AS event_date
        FROM m_order_events""",
    "quarantine": "SELECT 'orders.error' AS subject, 'malformed_json' AS reason FROM events WHERE event_type = 'error'",
    "stream_invoices": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS order_id, CAST(value AS DECIMAL(14,2)) AS amount,
               'issued' AS status, ts AS issued_at, CAST(ts AS DATE) + 30 AS due_date
        FROM events WHERE event_type = 'purchase'""",
    "stream_ledger_entries": """
        SELECT 'accounts_receivable' AS account, CAST(value AS DECIMAL(14,2)) AS debit,
               CAST(0 AS DECIMAL(14,2)) AS credit, 'invoice' AS ref_type, CAST(event_id AS VARCHAR) AS ref_id,
               'Invoice for order ' || CAST(event_id AS VARCHAR) || ' - AR debit' AS description, ts AS created_at
        FROM events WHERE event_type = 'purchase'
        UNION ALL
        SELECT 'revenue', CAST(0 AS DECIMAL(14,2)), CAST(value AS DECIMAL(14,2)), 'invoice', CAST(event_id AS VARCHAR),
               'Invoice for order ' || CAST(event_id AS VARCHAR) || ' - Revenue credit', ts
        FROM events WHERE event_type = 'purchase'""",
}
