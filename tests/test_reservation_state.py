"""Failing lines of rejected orders, and the stream consumer with compacted state."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import reservation as rsv
from ledgerlake.session import scratch_path
from ledgerlake.sources import events as ev
from ledgerlake.streaming import reservations as rs
from ledgerlake.streaming.ingest import read_event_stream

T0 = dt.datetime(2024, 1, 1)
ORDERS = "id long, customer_id long, status string, total_amount decimal(14,2), created_at timestamp_ntz"
ITEMS = "order_id long, line_number int, sku string, qty int, line_total decimal(14,2), created_at timestamp_ntz"
STOCK = "sku string, qty_on_hand int, reserved_qty int"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """So little data: fewer tasks a round."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def greedy(orders, items, stock):
    """Orders one by one, line by line: (order, reserved, failing line or None), and the stock left."""
    left = {s: h - r for s, h, r in stock}
    out = []
    for oid, created in sorted(orders, key=lambda o: (o[1], o[0])):
        trial, bad = dict(left), None
        for pos, (_, _, sku, qty, *_) in enumerate(sorted((i for i in items if i[0] == oid), key=lambda i: i[1]), 1):
            if sku not in trial:
                bad = (pos, sku, qty, None, "unknown_sku", f"Product {sku} not found in inventory")
            elif trial[sku] < qty:
                bad = (pos, sku, qty, trial[sku], "insufficient_stock", f"Insufficient stock for {sku}. Available: {trial[sku]}, Requested: {qty}")
            if bad:
                break
            trial[sku] -= qty
        if not bad:
            left = trial
        out.append((oid, bad is None, bad))
    return out, left


def case(seed, n=40, hot=0):
    rng = random.Random(seed)
    orders = [(i, T0 + dt.timedelta(hours=i // 2)) for i in range(1, n + 1)]
    items = []
    for oid, _ in orders:
        for line in range(rng.choice([0, 1, 2, 3, 5])):
            items.append((oid, line, rng.choice(["A", "B", "C", "D", "Z"] if rng.random() < .3 else ["A", "B", "C"]), rng.randint(1, 6), Decimal("1.00"), T0))
    items += [(n, 100 + k, "A", 1, Decimal("1.00"), T0) for k in range(hot)]
    stock = [("A", 60, 5), ("B", 30, 0), ("C", 25, 1), ("D", 3, 0)]
    return orders, items, stock


def frames(spark, orders, items, stock):
    return (spark.createDataFrame([(i, 1, "placed", Decimal("1.00"), t) for i, t in orders], ORDERS).repartition(3),
            spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(stock, STOCK))


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 200)])
def test_failing_lines_are_those_of_the_loop(spark, seed, hot):
    raw = case(seed, hot=hot)
    orders, items, stock = frames(spark, *raw)
    want, _ = greedy(*raw)
    decisions = rsv.reserve_orders(orders, items, stock)
    path = scratch_path(spark, "t-decisions")
    decisions.write.parquet(path)
    x0 = stock.select("sku", (F.col("qty_on_hand") - F.col("reserved_qty")).cast("long").alias("x0"))
    failing = rsv.failing_lines(rsv.with_positions(items), spark.read.parquet(path), x0)
    got = {r.order_id: (r.position, r.sku, r.qty, r.available, r.reason, r.error) for r in failing.collect()}
    assert got == {o: bad for o, ok, bad in want if not ok} and got
    messages = ev.decode_events(rsv.failing_line_events(failing)).collect()
    assert Counter((int(m.order_id), m.sku, m.reason) for m in messages) == Counter((o, b[1], b[4]) for o, b in got.items())
    assert rsv.failing_lines(rsv.with_positions(items.limit(0)), decisions.limit(0), x0).count() == 0


def _consumer(spark, root, stock, **kw):
    return rs.ReservationConsumer(spark, f"{root}/store", f"{root}/ckpt", stock, **kw)


def _drop(messages, root, name):
    messages.select("subject", "data").coalesce(1).write.json(f"{root}/in/{name}")


def test_ten_batches_with_split_orders_restarts_and_repeats(spark):
    raw = case(3)
    orders, items, stock = frames(spark, *raw)
    want, left = greedy(*raw)
    root = scratch_path(spark, "t-rstate")
    messages = ev.emit_orders_with_items(orders, items, per_message=2)
    field = lambda n: F.get_json_object("data", f"$.{n}").cast("int")
    path = scratch_path(spark, "t-messages")
    # Orders 1-4 complete in drop 0, 5-8 in drop 1, ...; parts but the last come one drop early.
    drop = F.floor((field("order_id") - 1) / 4)
    messages.withColumn("drop", F.greatest(F.lit(0), F.when(field("part") < field("parts") - 1, drop - 1).otherwise(drop))).write.parquet(path)
    sent = spark.read.parquet(path)
    reads = []
    for k in range(10):
        repeats = sent.where(F.col("drop") == k - 1) if k else sent.limit(0)  # the whole drop before, published again
        _drop(sent.where(F.col("drop") == k).unionByName(repeats), root, f"b{k}")
        consumer = _consumer(spark, root, stock)  # restarted each time
        consumer.run_available(read_event_stream(spark, f"{root}/in/*"))
        reads.append((sum(consumer.stock.version().rows.values()), sum(consumer.pending.version().rows.values()), len(consumer.stock._numbers())))
    got = spark.read.parquet(consumer.paths["reservations"]).collect()
    assert {int(r.order_id): r.reserved for r in got} == {o: ok for o, ok, _ in want} and len(got) == len(want)
    assert {r.sku: r.x0 - r.taken for r in consumer.stock.read().collect()} == left
    lines = {int(r.order_id): (r.position, r.sku, r.qty, r.available, r.reason, r.error) for r in spark.read.parquet(consumer.paths["failures"]).collect()}
    assert lines == {o: bad for o, ok, bad in want if not ok}
    out = ev.decode_events(spark.read.parquet(consumer.paths["outbox"]).select("subject", "data"))
    assert out.count() == out.select("event_key").distinct().count()
    assert out.where("event_type = 'reservation_failed'").count() == len(lines)
    # State doesn't grow with the history: one row a SKU, orders in flight only, few versions.
    assert {r[0] for r in reads} == {4} and reads[-1][1] == 0 and max(r[2] for r in reads) <= 3


@pytest.mark.parametrize("where", ["outbox", "stock", "pending"])
def test_a_retried_batch_decides_the_same(spark, monkeypatch, where):
    """A crash after any of a batch's commits; the same batch then runs again."""
    raw = case(4, n=12)
    orders, items, stock = frames(spark, *raw)
    want, left = greedy(*raw)
    root = scratch_path(spark, "t-retry")
    decoded = ev.decode_events(ev.emit_orders_with_items(orders, items, per_message=2))
    consumer = _consumer(spark, root, stock)
    consumer._seed()
    first, second = (decoded.where(F.col("order_id").cast("int") <= 6), decoded.where(F.col("order_id").cast("int") > 6))
    consumer.process_batch(first, 0)

    def crash(*_, **__):
        raise RuntimeError("lost")

    if where == "outbox":
        monkeypatch.setattr(consumer, "_messages", crash)
    else:
        done = getattr(consumer, where)
        call = "merge" if where == "stock" else "replace"
        real = getattr(done, call)

        def then_crash(*a, **k):
            real(*a, **k)
            raise RuntimeError("lost")

        monkeypatch.setattr(done, call, then_crash)
    with pytest.raises(RuntimeError, match="lost"):
        consumer.process_batch(second, 1)
    monkeypatch.undo()
    consumer = _consumer(spark, root, stock)
    consumer.process_batch(second, 1)
    got = spark.read.parquet(consumer.paths["reservations"]).collect()
    assert {int(r.order_id): r.reserved for r in got} == {o: ok for o, ok, _ in want} and len(got) == len(want)
    assert {r.sku: r.x0 - r.taken for r in consumer.stock.read().collect()} == left
    assert spark.read.parquet(consumer.paths["failures"]).count() == sum(not ok for _, ok, _ in want)


def test_seen_parts_are_forgotten_behind_the_watermark(spark):
    raw = ([(1, T0)], [(1, 1, "A", 2, Decimal("1.00"), T0)], [("A", 10, 0)])
    orders, items, stock = frames(spark, *raw)
    root = scratch_path(spark, "t-within")
    messages = ev.emit_orders_with_items(orders, items)
    for name in ("b0", "b1"):
        _drop(messages, root, name)
        consumer = _consumer(spark, root, stock, seen_within="1 hour")
        consumer.run_available(read_event_stream(spark, f"{root}/in/*"))
    assert [(r.sku, r.taken) for r in consumer.stock.read().collect()] == [("A", 2)]


def test_outbox_and_pending_use_several_tasks(spark):
    """A micro-batch's rows aren't all dealt to one task."""
    from ledgerlake.sources.sinks import overwrite_partitions
    path = scratch_path(spark, "t-sink")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as it is inside foreachBatch
    try:
        df = spark.range(0, 4000, 1, 8).withColumn("batch_id", F.lit(3))
        for _ in range(2):  # a retry replaces its own rows
            overwrite_partitions(df, path, "batch_id", deal=False)
        written = spark.read.parquet(path)
        assert written.count() == 4000 and len(written.inputFiles()) == 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_private_folder_on_a_cluster(spark):
    from ledgerlake import session

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(values)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_root(Session(**{"spark.master": master}))
    assert session.checkpoint_root(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"


def test_orders_of_one_time_are_decided_by_number(spark):
    """Ids come as text in messages; 9 is before 10 all the same, in decisions and in failing lines."""
    raw = ([(9, T0), (10, T0)], [(9, 1, "A", 7, Decimal("1.00"), T0), (10, 1, "A", 7, Decimal("1.00"), T0)], [("A", 10, 0)])
    orders, items, stock = frames(spark, *raw)
    root = scratch_path(spark, "t-number")
    messages = ev.emit_orders_with_items(orders, items)
    _drop(messages, root, "b0")
    consumer = _consumer(spark, root, stock)
    consumer.run_available(read_event_stream(spark, f"{root}/in/*"))
    assert {r.order_id: r.reserved for r in spark.read.parquet(consumer.paths["reservations"]).collect()} == {"9": True, "10": False}
    assert [(r.order_id, r.available) for r in spark.read.parquet(consumer.paths["failures"]).collect()] == [("10", 3)]
    from ledgerlake.streaming.ingest import IngestJob
    job = IngestJob(spark, store=f"{root}/job", checkpoint=f"{root}/job-ckpt", analytics=False, inventory=stock)
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    assert {r.order_id: r.reserved for r in spark.read.parquet(job.paths["reservations"]).collect()} == {"9": True, "10": False}


def test_messages_name_their_parts_and_carry_columns_beside(spark):
    """Parts are counted from the lines' numbers; columns beside the messages say what their text says."""
    import datetime as dt
    import json

    orders = spark.createDataFrame([(k, 1, "placed", 1.0, dt.datetime(2024, 1, 1, k)) for k in range(6)],
                                   "id long, customer_id long, status string, total_amount double, created_at timestamp")
    items = spark.createDataFrame([(k, dt.datetime(2024, 1, 2), j, f"s{j}", 1, 1.0) for k in range(5) for j in range(k)],
                                  "order_id long, created_at timestamp, line_number int, sku string, qty int, line_total double")
    got = ev.emit_orders_with_items(orders, items, per_message=2, beside={"last": F.col("part") == F.col("parts") - 1, "at": F.hour("created_at")}).collect()
    found = sorted((m["order_id"], m["part"], m["parts"], len(m["items"]), r.last, r.at) for r in got for m in [json.loads(r.data)])
    assert [f[:4] for f in found] == [(0, 0, 1, 0), (1, 0, 1, 1), (2, 0, 1, 2), (3, 0, 2, 2), (3, 1, 2, 1), (4, 0, 2, 2), (4, 1, 2, 2), (5, 0, 1, 0)]
    assert all(last == (part == parts - 1) and at == order for order, part, parts, _, last, at in found)


def test_reservations_keep_neither_keys_nor_messages_in_the_heap(spark, monkeypatch):
    """The seen keys of ``stream_reservations`` are in RocksDB, and its only micro-batch isn't cached."""
    import glob
    import os

    from ledgerlake.plans import extra
    from ledgerlake.streaming.ingest import ROCKSDB_CONF

    roots = []
    monkeypatch.setattr(extra, "scratch_path", lambda s, name: roots.append(scratch_path(s, name)) or roots[-1])

    def cached(*_):
        raise AssertionError("a batch is cached")

    monkeypatch.setattr(type(spark.range(1)), "persist", cached)
    before = {k: spark.conf.get(k, None) for k in ROCKSDB_CONF}
    got = extra.stream_reservations(spark, "/root/testdata/sf0.001")
    monkeypatch.undo()
    want = rsv.reserve_orders(*(getattr(extra.Warehouse(spark, "/root/testdata/sf0.001"), n) for n in ("orders", "order_items", "inventory_items")))
    rows = lambda df: sorted((int(r.order_id), r.created_at, r.reserved, r.reason) for r in df.collect())
    assert rows(got) == rows(want)
    kept = [os.path.splitext(p)[1] for p in glob.glob(f"{roots[0]}/checkpoint/state/0/*/*")]
    assert ".changelog" in kept and ".delta" not in kept
    assert {k: spark.conf.get(k, None) for k in ROCKSDB_CONF} == before  # other streams keep their kind of store
    assert not os.path.exists(f"{roots[0]}/numbered")


def test_drops_are_written_once_and_compressed(spark, monkeypatch):
    """Messages are on disk once, gzipped, in the inbox; nothing stays of how they were made."""
    import glob
    import os

    from ledgerlake.plans import extra

    roots = []
    monkeypatch.setattr(extra, "scratch_path", lambda s, name: roots.append(scratch_path(s, name)) or roots[-1])
    consumer = extra._dropped_reservations(spark, "/root/testdata/sf0.001")
    w = extra.Warehouse(spark, "/root/testdata/sf0.001")
    files = [p for p in glob.glob(f"{roots[0]}/**/*", recursive=True) if os.path.isfile(p) and "/store/" not in p and "/checkpoint/" not in p and not p.endswith("_SUCCESS")]
    assert files and all(p.startswith(f"{roots[0]}/inbox/") and p.endswith(".json.gz") for p in files)
    drops = {int(r.f.split("/")[-2]): r["count"] for r in spark.read.json(f"{roots[0]}/inbox/*").groupBy(F.input_file_name().alias("f")).count().collect()}
    assert set(drops) == set(range(extra.DROPS))
    sent = spark.read.json(f"{roots[0]}/inbox/*").select("subject", "data")
    want = ev.emit_orders_with_items(w.orders, w.order_items, per_message=2)
    assert Counter(sent.collect()) == Counter(want.collect())
    assert spark.read.parquet(consumer.paths["reservations"]).count() == w.orders.count()


def test_a_batch_leaves_its_tables_only(spark):
    """What the steps of a batch write for each other goes with the batch; the parts that were seen are in RocksDB."""
    import glob
    import os

    from ledgerlake.session import checkpoint_root

    raw = case(5, n=20)
    orders, items, stock = frames(spark, *raw)
    _, left = greedy(*raw)
    root = scratch_path(spark, "t-leaves")
    _drop(ev.emit_orders_with_items(orders, items, per_message=2), root, "b0")
    before = set(os.listdir(checkpoint_root(spark)))
    consumer = _consumer(spark, root, stock)
    consumer.run_available(read_event_stream(spark, f"{root}/in/*"))
    assert {r.sku: r.x0 - r.taken for r in consumer.stock.read().collect()} == left
    assert set(os.listdir(checkpoint_root(spark))) == before
    kept = [os.path.splitext(p)[1] for p in glob.glob(f"{root}/ckpt/state/0/*/*")]
    assert ".changelog" in kept and ".delta" not in kept
