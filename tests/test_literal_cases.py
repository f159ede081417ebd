"""The literal cases of the reference system's tests, re-run on our operators."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import inventory as inv
from ledgerlake.operators import orders as ordops
from ledgerlake.operators import quality
from ledgerlake.operators import receivables as ar
from ledgerlake.operators import reservation as rsv
from ledgerlake.operators import sales
from ledgerlake.operators.upsert import insert_if_absent, upsert_latest
from ledgerlake.plans.catalogue import QueryRejected, list_queries, run_query
from ledgerlake.sources import events as ev

from conftest import SF_SMALL

D = Decimal
T0 = dt.datetime(2024, 1, 15, 10, 30)


def order_events(spark, rows):
    return spark.createDataFrame(
        rows, "id long, order_id long, event_type string, customer_id long, total_amount decimal(14,2), "
              "status string, event_timestamp timestamp_ntz")


def test_hourly_sum_two_orders(spark):
    df = order_events(spark, [(1, 1, "order_created", 7, D("100.00"), "placed", T0),
                              (2, 2, "order_created", 8, D("50.00"), "placed", T0)])
    r = sales.sales_by_hour(df).collect()
    assert len(r) == 1
    assert r[0].hour == dt.datetime(2024, 1, 15, 10, 0)
    assert (r[0].total_orders, r[0].total_revenue, r[0].avg_order_value) == (2, D("150.00"), 75.0)
    assert r[0].unique_customers == 2


def test_duplicate_event_logged_once(spark):
    msg = ('{"event_id": "evt_duplicate", "order_id": 1, "customer_id": 2, "total_amount": 10.5,'
           ' "timestamp": "2024-01-15T10:30:00"}')
    raw = spark.createDataFrame([("orders.order_created", msg)] * 2, "subject string, data string")
    logged = ev.order_log_rows(ev.decode_events(raw).dropDuplicates(["event_key"])).collect()
    assert len(logged) == 1 and logged[0].status == "placed"


def _stock(spark, rows):
    items = spark.createDataFrame(
        [(s, a, b, c, T0) for s, a, b, c in rows],
        "sku string, qty_on_hand int, reserved_qty int, reorder_point int, updated_at timestamp_ntz")
    products = spark.createDataFrame([(s, f"name {s}", "", D("1.00"), "b") for s, *_ in rows],
                                     "sku string, name string, description string, price decimal(12,2), brand string")
    return products, items


def test_snapshot_and_upsert_flip_reorder(spark):
    p, i = _stock(spark, [("WIDGET-001", 100, 10, 20)])
    snap = inv.stock_snapshot(p, i).collect()[0]
    assert (snap.available_qty, snap.needs_reorder) == (90, False)
    p2, i2 = _stock(spark, [("WIDGET-001", 15, 5, 20)])
    old = inv.stock_snapshot(p, i).withColumn("v", F.lit(1))
    new = inv.stock_snapshot(p2, i2).withColumn("v", F.lit(2))
    up = upsert_latest(old, new, ["sku"], "v").collect()
    assert len(up) == 1 and (up[0].available_qty, up[0].needs_reorder) == (10, True)


def test_low_stock_only_reorder_rows(spark):
    p, i = _stock(spark, [("A", 5, 0, 10), ("B", 100, 10, 20)])
    rows = inv.low_stock(inv.stock_snapshot(p, i)).collect()
    assert [r.sku for r in rows] == ["A"]


@pytest.mark.parametrize("lines,total", [([(2, "19.99"), (1, "49.99")], "89.97"), ([(10, "99.99")], "999.90")])
def test_order_totals(spark, lines, total):
    items = spark.createDataFrame(
        [(1, n, f"S{n}", q, D(p)) for n, (q, p) in enumerate(lines)],
        "order_id long, line_number int, sku string, qty int, price decimal(12,2)")
    products = spark.createDataFrame([(f"S{n}", "x", D(p)) for n, (_, p) in enumerate(lines)],
                                     "sku string, name string, price decimal(12,2)")
    priced = ordops.price_order_items(items, products).withColumnRenamed("qty", "qty")
    got = ordops.order_totals(priced).collect()[0].order_total
    assert got == D(total)


def _reserve(spark, stock, orders):
    """stock: {sku: (on_hand, reserved)}; orders: [(order_id, day, [(sku, qty)])]"""
    inv_df = spark.createDataFrame([(s, a, b, 0, T0) for s, (a, b) in stock.items()],
                                   "sku string, qty_on_hand int, reserved_qty int, reorder_point int, "
                                   "updated_at timestamp_ntz")
    o = spark.createDataFrame([(oid, T0 + dt.timedelta(days=d)) for oid, d, _ in orders],
                              "id long, created_at timestamp_ntz")
    items = spark.createDataFrame([(oid, n, s, q) for oid, _, ls in orders for n, (s, q) in enumerate(ls)],
                                  "order_id long, line_number int, sku string, qty int")
    dec = rsv.reserve_orders(o, items, inv_df)
    after = {r.sku: (r.qty_on_hand, r.reserved_qty) for r in rsv.reserved_inventory(inv_df, items, dec).collect()}
    return {r.order_id: (r.reserved, r.reason) for r in dec.collect()}, after


def test_reserve_10_of_100(spark):
    dec, after = _reserve(spark, {"S": (100, 0)}, [(1, 0, [("S", 10)])])
    assert dec[1] == (True, None) and after["S"] == (100, 10)


def test_reserve_too_much_rejected(spark):
    dec, after = _reserve(spark, {"S": (5, 0)}, [(1, 0, [("S", 10)])])
    assert dec[1] == (False, "insufficient_stock") and after["S"] == (5, 0)


def test_two_reservations_accumulate(spark):
    dec, after = _reserve(spark, {"S": (100, 0)}, [(1, 0, [("S", 10)]), (2, 1, [("S", 20)])])
    assert dec[1][0] and dec[2][0] and after["S"] == (100, 30)


def test_all_or_nothing_and_later_smaller_order(spark):
    dec, after = _reserve(spark, {"A": (10, 0), "B": (5, 0)},
                          [(1, 0, [("A", 4), ("B", 9)]),    # B fails -> A not reserved
                           (2, 1, [("A", 8)]),              # fits because order 1 rolled back
                           (3, 2, [("A", 5)]),              # only 2 left -> rejected
                           (4, 3, [("A", 2), ("Z", 1)]),    # unknown SKU
                           (5, 4, [("A", 2)])])             # smaller order still succeeds
    assert {k: v[0] for k, v in dec.items()} == {1: False, 2: True, 3: False, 4: False, 5: True}
    assert dec[4][1] == "unknown_sku"
    assert after["A"] == (10, 10) and after["B"] == (5, 0)


def test_invalid_product_price(spark):
    products = spark.createDataFrame([("P1", "x", D("-5.00")), ("P2", "y", D("1.00"))],
                                     "sku string, name string, price decimal(12,2)")
    rules = quality.table_rules()["products"]
    bad = quality.violations(products, rules, "sku").collect()
    assert [(r.row_key, r.violations) for r in bad] == [("P1", ["price_non_negative"])]


def test_order_without_items_is_reported(spark):
    orders = spark.createDataFrame([(1,), (2,)], "id long")
    items = spark.createDataFrame([(1, "S", 1)], "order_id long, sku string, qty int")
    assert [r.id for r in quality.orders_without_items(orders, items).collect()] == [2]


def test_catalogue_limits(spark):
    with pytest.raises(QueryRejected):
        run_query(spark, SF_SMALL, "sales_24h", limit=2000)
    with pytest.raises(QueryRejected):
        run_query(spark, SF_SMALL, "no_such_query")
    assert run_query(spark, SF_SMALL, "stock_movement", limit=5).count() == 5
    assert list_queries(spark).count() == 8


def _invoices(spark, rows, as_of):
    base = dt.date.fromisoformat(as_of)
    inv_df = spark.createDataFrame(
        [(n, n, D(a), st, dt.datetime.combine(base - dt.timedelta(days=pd + 30), dt.time()),
          base - dt.timedelta(days=pd), None)
         for n, (cust, a, pd, st) in enumerate(rows)],
        "id long, order_id long, amount decimal(14,2), status string, issued_at timestamp_ntz, "
        "due_date date, paid_at timestamp_ntz")
    orders = spark.createDataFrame([(n, cust) for n, (cust, *_rest) in enumerate(rows)], "id long, customer_id long")
    customers = spark.createDataFrame([(1, "Acme Corp"), (2, "TechStart Inc")], "id long, name string")
    return inv_df, orders, customers


def test_ar_aging_buckets_and_edges(spark):
    as_of = "2024-03-01"
    rows = [(1, "2000.00", 10, "issued"), (1, "2000.00", 35, "issued"), (1, "1000.00", 65, "issued"),
            (2, "1500.00", -5, "issued"),
            (2, "1.00", 29, "issued"), (2, "2.00", 30, "issued"), (2, "4.00", 59, "issued"),
            (2, "8.00", 60, "issued"), (2, "16.00", 89, "issued"), (2, "32.00", 90, "issued"),
            (1, "999.00", 120, "paid"), (1, "777.00", 120, "cancelled")]
    i, o, c = _invoices(spark, rows, as_of)
    got = {r.customer_id: r for r in ar.ar_aging(i, o, c, as_of).collect()}
    a = got[1]
    assert (a.total_outstanding, a.current_amount, a.days_30, a.days_60, a.days_90_plus) == \
        (D("5000.00"), D("2000.00"), D("2000.00"), D("1000.00"), D("0.00"))
    b = got[2]
    assert (b.current_amount, b.days_30, b.days_60, b.days_90_plus) == \
        (D("1501.00"), D("6.00"), D("24.00"), D("32.00"))
    for r in got.values():
        assert r.current_amount + r.days_30 + r.days_60 + r.days_90_plus == r.total_outstanding
    flags = {r.status: r.is_overdue for r in ar.invoice_overdue_flag(i, as_of).collect() if r.status != "issued"}
    assert flags == {"paid": False, "cancelled": False}


def test_repair_null_quantities(spark):
    items = spark.createDataFrame([("A", None, 3, 1, T0), ("B", 4, None, 1, T0)],
                                  "sku string, qty_on_hand int, reserved_qty int, reorder_point int, "
                                  "updated_at timestamp_ntz")
    got = {r.sku: (r.qty_on_hand, r.reserved_qty) for r in inv.repair_quantities(items).collect()}
    assert got == {"A": (0, 3), "B": (4, 0)}


def test_insert_if_absent_keeps_existing(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    got = sorted((r.k, r.v) for r in insert_if_absent(new, old, ["k"]).collect())
    assert got == [(1, "old"), (2, "new")]


def test_illegal_transitions(spark):
    h = spark.createDataFrame([(1, "draft", T0, 1), (1, "shipped", T0, 2), (2, "draft", T0, 1),
                               (2, "placed", T0, 2), (2, "shipped", T0, 3), (2, "completed", T0, 4)],
                              "order_id long, status string, ts timestamp_ntz, seq int")
    bad = [(r.order_id, r.from_status, r.to_status) for r in ordops.illegal_transitions(h).collect()]
    assert bad == [(1, "draft", "shipped")]
    cur = {r.order_id: r.current_status for r in ordops.order_current_status(h).collect()}
    assert cur == {1: "shipped", 2: "completed"}


def test_payload_defaults_and_compat_key(spark):
    raw = spark.createDataFrame([
        ("orders.stock_reserved", '{"order_id": 5, "sku": "S", "qty": 3, "timestamp": "2024-01-01T00:00:00"}'),
        ("orders.invoice_created", '{"invoice_id": 9, "order_id": 5, "due_date": "2024-02-01",'
                                   ' "timestamp": "2024-01-01T00:00:00"}'),
        ("orders.reservation_failed", '{"order_id": 6, "error": "x"}'),
        ("orders.unknown", '{"order_id": 7, "timestamp": "2024-01-01T00:00:00"}')],
        "subject string, data string")
    d = {r.event_type: r for r in ev.decode_events(raw).collect()}
    assert d["stock_reserved"].qty_reserved == 3
    assert d["invoice_created"].status == "issued" and d["invoice_created"].amount == D("0.00")
    assert d["reservation_failed"].is_valid is False  # no timestamp
    counts = {r.handler: r.messages for r in ev.route_counts(ev.decode_events(raw)).collect()}
    assert counts["skipped"] == 1
    compat = ev.decode_events(raw, compat_key=True).filter("event_type = 'stock_reserved'").first()
    assert compat.event_key == "orders.stock_reserved:5"


def test_large_orders_are_split_into_bounded_messages(spark):
    orders = spark.createDataFrame([(1, 7, "draft", D("10.00"), T0), (2, 8, "placed", D("5.00"), T0)],
                                   "id long, customer_id long, status string, total_amount decimal(14,2), "
                                   "created_at timestamp_ntz")
    items = spark.createDataFrame(
        [(1, n, f"S{n}", n, D(f"{n}.00"), T0 + dt.timedelta(hours=5 - n)) for n in range(1, 6)],
        "order_id long, line_number int, sku string, qty int, line_total decimal(14,2), created_at timestamp_ntz")
    msgs = ev.emit_orders_with_items(orders, items, per_message=2)
    assert msgs.count() == 4  # order 1 in parts of 2+2+1, order 2 one empty part
    got = sorted((r.order_id, r.position, r.sku) for r in ev.explode_items(ev.decode_events(msgs)).collect())
    # item order is by created_at: S5 is earliest
    assert got == [("1", 1, "S5"), ("1", 2, "S4"), ("1", 3, "S3"), ("1", 4, "S2"), ("1", 5, "S1")]


def test_uuid_format_rule(spark):
    df = spark.createDataFrame([("550e8400-e29b-41d4-a716-446655440001",), ("order-1",)], "id string")
    bad = quality.violations(df, [quality.uuid_rule("id")], "id").collect()
    assert [(r.row_key, r.violations) for r in bad] == [("order-1", ["id_uuid_format"])]


def test_query_envelope(spark):
    from ledgerlake.plans.catalogue import query_envelope
    env = query_envelope(spark, SF_SMALL, "top_customers", limit=5)
    assert env["columns"] == ["customer_id", "customer_name", "total_outstanding"]
    assert env["row_count"] == len(env["rows"]) == 5


def test_string_ids_and_offsets(spark):
    """Ids are opaque strings; a time with an offset is converted to UTC."""
    rows = [
        ("orders.order_created", '{"event_id": "ev-1", "order_id": "ord-a7", "customer_id": "cus-x", "total_amount": 99.5,'
                                 ' "status": "placed", "timestamp": "2025-10-04T23:30:00-05:00"}'),
        ("orders.stock_reserved", '{"event_id": "ev-2", "order_id": "ord-a7", "sku": "W-1", "qty_reserved": 4, "timestamp": "2025-10-04T08:00:00Z"}'),
        ("orders.invoice_created", '{"event_id": "ev-3", "invoice_id": "inv-k", "order_id": "ord-a7", "amount": 99.5, "status": "issued",'
                                   ' "due_date": "2025-11-03", "timestamp": "2025-10-04T08:00:00.250000"}')]
    d = ev.decode_events(spark.createDataFrame(rows, "subject string, data string"))
    assert ev.quarantine_rows(d).count() == 0
    o = ev.order_log_rows(d).first()
    assert (o.order_id, o.customer_id, o.total_amount) == ("ord-a7", "cus-x", D("99.50"))
    assert o.event_timestamp == dt.datetime(2025, 10, 5, 4, 30) and o.event_date == dt.date(2025, 10, 5)
    s = ev.stock_log_rows(d).first()
    assert (s.order_id, s.sku, s.qty_reserved, s.event_timestamp) == ("ord-a7", "W-1", 4, dt.datetime(2025, 10, 4, 8))
    i = ev.invoice_log_rows(d).first()
    assert (i.invoice_id, i.order_id, i.amount, i.event_timestamp) == ("inv-k", "ord-a7", D("99.50"), dt.datetime(2025, 10, 4, 8, 0, 0, 250000))


def test_current_status_stays_a_hash_aggregate(spark):
    h = spark.createDataFrame([(1, "draft", T0, 1)], "order_id long, status string, ts timestamp_ntz, seq int")
    plan = ordops.order_current_status(h)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_earliest_of_repeated_orders_is_invoiced(spark):
    from ledgerlake.operators import ledger
    o = spark.createDataFrame([(1, D("5.00"), T0 + dt.timedelta(1)), (1, D("9.00"), T0), (2, D("1.00"), T0)],
                              "id long, total_amount decimal(14,2), created_at timestamp_ntz")
    inv = spark.createDataFrame([(2,)], "order_id long")
    assert [(r.id, r.amount) for r in ledger.generate_invoices(o, inv, "2024-02-01").collect()] == [(1, D("9.00"))]


def test_valid_references_repeat_no_row(spark):
    from ledgerlake.operators.quality import valid_references
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "x"), (None, "a")], "o long, s string")
    parents = spark.createDataFrame([(1,), (1,), (3,)], "id long"), spark.createDataFrame([("a",)], "k string")
    got = valid_references(child, {"o": (parents[0], "id"), "s": (parents[1], "k")})
    assert [(r.o, r.s) for r in got.collect()] == [(1, "a"), (1, "a")]
