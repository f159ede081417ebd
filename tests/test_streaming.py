"""Stream = batch: the ingest job over split, shuffled, duplicated files
produces the same tables as the batch operators."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import sales
from ledgerlake.session import scratch_path
from ledgerlake.sources import events as ev
from ledgerlake.sources.sinks import overwrite_partitions
from ledgerlake.sources.tables import Warehouse
from ledgerlake.streaming.ingest import IngestJob, _read_or_none, read_event_stream, windowed_sales, write_messages

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_with_duplicates(spark):
    w = Warehouse(spark, SF_SMALL)
    msgs = ev.emit_raw_events(w.raw("events"))
    root = scratch_path(spark, "t-stream")
    # shuffled order, every message twice, in 6 files
    write_messages(msgs.unionByName(msgs).orderBy(F.rand(7)), f"{root}/in", 6)
    job = IngestJob(spark, f"{root}/store", f"{root}/ckpt", billing=True)
    job.run_available(read_event_stream(spark, f"{root}/in", 2))
    got = spark.read.parquet(job.paths["sales_by_hour"]).drop("sales_date")
    assert _rows(got) == _rows(sales.sales_by_hour(w.order_events))
    job.rebuild_sales()  # rebuild from the whole log gives the same table
    rebuilt = spark.read.parquet(job.paths["sales_by_hour"] + "_rebuilt").drop("sales_date")
    assert _rows(rebuilt) == _rows(got)
    log = spark.read.parquet(job.paths["order_events"])
    assert log.count() == w.order_events.count()
    inv = spark.read.parquet(job.paths["invoices"])
    assert inv.count() == w.order_events.filter("event_type = 'order_created'").count()
    led = spark.read.parquet(job.paths["ledger_entries"])
    bal = led.agg(F.sum("debit").alias("d"), F.sum("credit").alias("c")).first()
    assert bal.d == bal.c


def test_late_event_updates_closed_hour_and_retry_is_idempotent(spark):
    root = scratch_path(spark, "t-late")

    def msg(eid, ts, amt):
        return ("orders.order_created",
                f'{{"event_id": "{eid}", "order_id": {eid}, "customer_id": 1, "total_amount": {amt},'
                f' "timestamp": "{ts}"}}')
    schema = "subject string, data string"
    spark.createDataFrame([msg(1, "2024-01-01T10:05:00", 10), msg(2, "2024-01-01T11:05:00", 5)], schema) \
        .coalesce(1).write.json(f"{root}/in/b1")
    job = IngestJob(spark, f"{root}/store", f"{root}/ckpt")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    # a late event for 10:00 arrives later, plus a redelivery of event 1
    spark.createDataFrame([msg(3, "2024-01-01T10:59:00", 20), msg(1, "2024-01-01T10:05:00", 10)], schema) \
        .coalesce(1).write.json(f"{root}/in/b2")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    got = {r.hour.hour: (r.total_orders, r.total_revenue)
           for r in spark.read.parquet(job.paths["sales_by_hour"]).collect()}
    assert got == {10: (2, Decimal("30.00")), 11: (1, Decimal("5.00"))}
    # re-running a batch id overwrites its own partitions only
    before = spark.read.parquet(job.paths["order_events"]).count()
    batch = ev.decode_events(spark.createDataFrame([msg(3, "2024-01-01T10:59:00", 20)], schema))
    job.process_batch(batch, 1)
    assert spark.read.parquet(job.paths["order_events"]).count() == before


def test_quarantine_and_windowed_update_mode(spark):
    root = scratch_path(spark, "t-win")
    rows = [("orders.order_created",
             f'{{"event_id": "e{i}", "order_id": {i}, "customer_id": {i % 3}, "total_amount": 1.5,'
             f' "timestamp": "2024-01-01T0{i % 3}:10:00"}}') for i in range(9)]
    rows.append(("orders.order_created", '{"event_id": "bad", "order_id": '))
    spark.createDataFrame(rows, "subject string, data string").coalesce(1).write.json(f"{root}/in")
    job = IngestJob(spark, f"{root}/store", f"{root}/ckpt")
    job.run_available(read_event_stream(spark, f"{root}/in"))
    q = spark.read.parquet(job.paths["quarantine"]).collect()
    assert [(r.reason) for r in q] == ["malformed_json"]
    stream = ev.decode_events(read_event_stream(spark, f"{root}/in"))
    name = "win_" + dt.datetime.now().strftime("%H%M%S%f")
    wq = (windowed_sales(stream).writeStream.outputMode("update").format("memory").queryName(name)
          .option("checkpointLocation", f"{root}/wckpt").trigger(availableNow=True).start())
    wq.awaitTermination()
    got = {r.hour.hour: r.total_orders for r in spark.sql(f"select * from {name}").collect()}
    assert got == {0: 3, 1: 3, 2: 3}


def test_streaming_reservation_carries_state_across_batches(spark):
    from ledgerlake.operators.reservation import reserve_orders
    t0 = dt.datetime(2024, 1, 1)
    inv = spark.createDataFrame([("A", 10, 0, 0, t0), ("B", 5, 1, 0, t0)],
                                "sku string, qty_on_hand int, reserved_qty int, reorder_point int, "
                                "updated_at timestamp_ntz")
    orders = spark.createDataFrame(
        [(i, 1, "draft", Decimal("1.00"), t0 + dt.timedelta(hours=i)) for i in range(1, 7)],
        "id long, customer_id long, status string, total_amount decimal(14,2), created_at timestamp_ntz")
    items = spark.createDataFrame(
        [(1, 1, "A", 4), (1, 2, "B", 2), (2, 1, "A", 5), (3, 1, "B", 3), (4, 1, "A", 2),
         (5, 1, "B", 2), (5, 2, "Z", 1), (6, 1, "A", 1)],
        "order_id long, line_number int, sku string, qty int").withColumn(
        "line_total", F.lit(Decimal("1.00")).cast("decimal(14,2)")).withColumn("created_at", F.lit(t0))
    root = scratch_path(spark, "t-res")
    msgs = ev.emit_orders_with_items(orders, items)
    job = IngestJob(spark, f"{root}/store", f"{root}/ckpt", inventory=inv)
    # first drop: orders 1-3, second drop: orders 4-6 plus a redelivery of order 2
    first = msgs.filter(F.get_json_object("data", "$.order_id").cast("long") <= 3)
    first.coalesce(1).write.json(f"{root}/in/b1")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    msgs.filter(F.get_json_object("data", "$.order_id").cast("long") >= 2).coalesce(1).write.json(f"{root}/in/b2")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    got = {r.order_id: r.reserved for r in spark.read.parquet(job.paths["reservations"]).collect()}
    want = {r.order_id: r.reserved for r in reserve_orders(orders, items, inv).collect()}
    # A: 10 -> o1 takes 4, o2 takes 5, o4 (2) fails, o6 takes 1; B: 4 -> o1 takes 2, o3 (3) fails
    assert {int(k): v for k, v in got.items()} == want == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    out = ev.decode_events(spark.read.parquet(job.paths["outbox"]).select("subject", "data"))
    assert out.filter("event_type = 'stock_reserved'").count() == 4
    assert {r.qty_reserved for r in out.filter("event_type = 'reservation_failed'").collect()} == {0}


def test_dedup_within_watermark_window(spark):
    """Broker-style duplicate window: a redelivery inside the watermark is
    dropped; the bounded state forgets keys once event time moves on."""
    from ledgerlake.streaming.ingest import dedup_stream
    root = scratch_path(spark, "t-wm")

    def msg(eid, ts):
        return ("orders.order_created",
                f'{{"event_id": "{eid}", "order_id": 1, "customer_id": 1, "total_amount": 1, "timestamp": "{ts}"}}')
    spark.createDataFrame([msg("a", "2024-01-01T10:00:00"), msg("a", "2024-01-01T10:00:30"),
                           msg("b", "2024-01-01T10:01:00")], "subject string, data string") \
        .coalesce(1).write.json(f"{root}/in")
    stream = dedup_stream(ev.decode_events(read_event_stream(spark, f"{root}/in")), watermark="2 minutes")
    name = "wm_" + dt.datetime.now().strftime("%H%M%S%f")
    q = (stream.select("event_key").writeStream.format("memory").queryName(name)
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.event_key for r in spark.sql(f"select * from {name}").collect()) == ["a", "b"]


def test_billing_consumer_with_order_level_idempotency(spark):
    root = scratch_path(spark, "t-bill")

    def msg(eid, oid, ts):
        return ("orders.order_created",
                f'{{"event_id": "{eid}", "order_id": {oid}, "customer_id": 1, "total_amount": 9.5,'
                f' "timestamp": "{ts}"}}')
    schema = "subject string, data string"
    spark.createDataFrame([msg("e1", 1, "2024-01-01T10:00:00"), msg("e2", 2, "2024-01-01T11:00:00")], schema) \
        .coalesce(1).write.json(f"{root}/in/b1")
    job = IngestJob(spark, f"{root}/store", f"{root}/ckpt", analytics=False, billing=True, idempotency="order")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    # the same order re-published under a new event id in a later batch
    spark.createDataFrame([msg("e9", 1, "2024-01-01T10:00:00"), msg("e3", 3, "2024-01-02T09:00:00")], schema) \
        .coalesce(1).write.json(f"{root}/in/b2")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    inv = spark.read.parquet(job.paths["invoices"])
    assert sorted(r.order_id for r in inv.collect()) == ["1", "2", "3"]
    assert spark.read.parquet(job.paths["ledger_entries"]).count() == 6


def _big_order(spark, stock):
    """One order of 10.00 with five lines, sent in three parts; and stock per SKU."""
    t0 = dt.datetime(2024, 1, 1, 9)
    orders = spark.createDataFrame([(1, 1, "placed", Decimal("10.00"), t0)],
                                   "id long, customer_id long, status string, total_amount decimal(14,2), created_at timestamp_ntz")
    items = spark.createDataFrame([(1, n, f"S{n}", 1, Decimal("2.00"), t0) for n in range(1, 6)],
                                  "order_id long, line_number int, sku string, qty int, line_total decimal(14,2), created_at timestamp_ntz")
    inv = spark.createDataFrame([(f"S{n}", q, 0) for n, q in stock.items()], "sku string, qty_on_hand int, reserved_qty int")
    return ev.emit_orders_with_items(orders, items, per_message=2), inv


def test_order_in_parts_counts_once(spark):
    msgs, _ = _big_order(spark, {})
    assert msgs.count() == 3
    log = ev.order_log_rows(ev.decode_events(msgs))
    row = sales.sales_by_hour(log).first()
    assert (row.total_orders, row.total_revenue) == (1, Decimal("10.00"))


@pytest.mark.parametrize("last_stock,reserved", [(0, False), (1, True)])
def test_parts_over_two_batches_are_reserved_together(spark, last_stock, reserved):
    msgs, inv = _big_order(spark, {1: 5, 2: 5, 3: 5, 4: 5, 5: last_stock})
    root = scratch_path(spark, "t-parts")
    part = F.get_json_object("data", "$.part").cast("int")
    job = IngestJob(spark, f"{root}/store", f"{root}/ckpt", analytics=False, inventory=inv)
    msgs.filter(part == 0).coalesce(1).write.json(f"{root}/in/b1")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    assert not os.path.exists(job.paths["reservations"].replace("file://", ""))
    spark.createDataFrame([("orders.other", "{}")], "subject string, data string").coalesce(1).write.json(f"{root}/in/b2")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))  # a batch without orders keeps what waits
    msgs.filter(part > 0).coalesce(1).write.json(f"{root}/in/b3")
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    got = spark.read.parquet(job.paths["reservations"]).collect()
    assert [(r.order_id, r.reserved) for r in got] == [("1", reserved)]
    booked = spark.read.schema("sku string, qty long, batch_id int").parquet(job.paths["reserved_qty"]).agg(F.sum("qty")).first()[0]
    assert booked == (5 if reserved else None)
    out = ev.decode_events(spark.read.parquet(job.paths["outbox"]).select("subject", "data")).collect()
    assert len({r.event_key for r in out}) == 5
    assert {r.reason for r in out} == ({None} if reserved else {"insufficient_stock"})


def test_partitioned_write_makes_one_file_a_folder(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("d")).repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as it is inside foreachBatch
    try:
        for files in (1, 4):
            path = f"file://{tmp_path}/t{files}"
            overwrite_partitions(df, path, "d", files=files)
            n = len(spark.read.parquet(path).inputFiles())
            assert n == 3 if files == 1 else 3 < n <= 12
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_read_errors_are_not_taken_for_absence(spark, tmp_path):
    assert _read_or_none(spark, f"file://{tmp_path}/nothing") is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)footer|parquet|FAILED_READ_FILE"):
        _read_or_none(spark, f"file://{tmp_path}/broken")
