"""Row ids, log compaction, late rows, bounded stream state, key lookups and nested items."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.orders import nested_order_items
from ledgerlake.session import scratch_path
from ledgerlake.sources import events as ev
from ledgerlake.sources.event_log import EventLog, with_row_ids
from ledgerlake.sources.versioned import VersionedTable
from ledgerlake.streaming.ingest import IngestJob, read_event_stream, seen_keys
from ledgerlake.streaming.late import WindowedSales

DAY = dt.date(2024, 1, 1)
NOW = dt.datetime(2024, 2, 1, 12)
LOG = "event_key string, event_date date"


def part(spark, start, n, days=3):
    return spark.createDataFrame([(f"e{start + k}", DAY + dt.timedelta(days=k % days)) for k in range(n)], LOG).repartition(5)


def test_ids_are_gapless_whatever_the_partitions(spark):
    got = with_row_ids(part(spark, 0, 101), 40).collect()
    assert sorted(r.id for r in got) == list(range(41, 142)) and len({r.event_key for r in got}) == 101
    assert with_row_ids(part(spark, 0, 0), 3).count() == 0


def test_log_appends_once_and_compacts_under_a_reader(spark, monkeypatch):
    log = EventLog(spark, scratch_path(spark, "t-log"), LOG)
    for batch in range(5):
        for _ in range(2):  # a retry
            log.append(part(spark, batch * 10, 10), "s", batch, NOW)
    rows = log.read().collect()
    assert sorted(r.id for r in rows) == list(range(1, 51)) and Counter(r.event_key for r in rows) == Counter(f"e{k}" for k in range(50))
    assert {r.processed_at for r in rows} == {NOW}
    # Ids of a batch follow those of the batches before.
    assert all((r.id - 1) // 10 == int(r.event_key[1:]) // 10 for r in rows)
    reader, before = log.read(), log.version()
    parts = len(before.segments)
    done = log.compact(2)
    assert parts == 15 and len(done.segments) == 3 and log.compact(2).number == done.number
    assert Counter(map(tuple, reader.collect())) == Counter(map(tuple, rows)) == Counter(map(tuple, log.read().collect()))
    assert {r.event_date for r in log.between("2024-01-02", "2024-01-02").collect()} == {DAY + dt.timedelta(1)}
    log.append(part(spark, 50, 10), "s", 5, NOW)
    assert sorted(r.id for r in log.read().collect()) == list(range(1, 61))
    # A crash before the commit: the batch comes again and takes the same ids.
    monkeypatch.setattr(log.files, "put_new", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        log.append(part(spark, 60, 10), "s", 6, NOW)
    monkeypatch.undo()
    assert log.read().count() == 60
    log.append(part(spark, 60, 10), "s", 6, NOW)
    assert sorted(r.id for r in log.read().collect()) == list(range(1, 71))


def test_append_and_compaction_at_once(spark):
    """The compactor commits while a batch is being written, and the other way round."""
    path = scratch_path(spark, "t-log")
    log, other = EventLog(spark, path, LOG), EventLog(spark, path, LOG)
    for batch in range(4):
        log.append(part(spark, batch * 10, 10, days=1), "s", batch, NOW)
    write = log._write
    log._write = lambda df: (write(df), other.compact(2))[0]
    log.append(part(spark, 40, 10, days=1), "s", 4, NOW)
    log._write = write
    assert sorted(r.id for r in log.read().collect()) == list(range(1, 51)) and len(log.version().segments) == 2
    log.append(part(spark, 50, 10, days=1), "s", 5, NOW)
    slow = other._write
    other._write = lambda df: (slow(df), log.append(part(spark, 60, 10, days=1), "s", 6, NOW))[0]
    other.compact(2)
    assert sorted(r.id for r in log.read().collect()) == list(range(1, 71)) and len(log.version().segments) == 2


def message(eid, ts, order=None, amount=1):
    return ("orders.order_created", json.dumps({"event_id": eid, "order_id": order or eid, "customer_id": "c", "total_amount": amount, "timestamp": ts}))


def drop(spark, root, name, messages):
    spark.createDataFrame(messages, "subject string, data string").coalesce(1).write.json(f"{root}/in/{name}")


def test_late_rows_are_reported_and_kept(spark):
    root = scratch_path(spark, "t-late")
    job = WindowedSales(spark, f"{root}/store", f"{root}/ckpt", delay_minutes=60)
    assert job.report().count() == 0
    drop(spark, root, "b0", [message("a", "2024-01-01T10:05:00"), message("b", "2024-01-01T12:30:00")])
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    # The watermark is 11:30 now: the hour from 10 ended before it, that from 11 not.
    late = [message("c", "2024-01-01T10:59:00", amount=7), message("d", "2024-01-01T11:00:00"), message("a", "2024-01-01T10:05:00"), message("e", "2024-01-01T14:00:00")]
    drop(spark, root, "b1", late)
    job.run_available(read_event_stream(spark, f"{root}/in/*"))
    job.process_batch(ev.decode_events(spark.createDataFrame(late[:2] + late[3:], "subject string, data string")), 1)  # again
    want = [(None, 2, 0, 0), (dt.datetime(2024, 1, 1, 11, 30), 2, 1, 1)]
    assert sorted(map(tuple, job.report().collect()), key=lambda r: r[3]) == want
    assert [(r.order_id, r.total_amount, r.batch_id) for r in job.late_rows().collect()] == [("c", Decimal("7.00"), 1)]
    assert {r.hour.hour: r.total_orders for r in job.sales.read().collect()} == {10: 1, 11: 1, 12: 1, 14: 1}


def test_bounded_state_levels_off_in_rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    root = scratch_path(spark, "t-rocks")
    sizes = []
    try:
        for k in range(6):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
            new = [message(f"m{k}-{n}", (at + dt.timedelta(minutes=n)).isoformat()) for n in range(20)]
            again = [message(f"m{k - 1}-{n}", (at - dt.timedelta(hours=1) + dt.timedelta(minutes=n)).isoformat()) for n in range(15, 20)] if k else []
            drop(spark, root, f"b{k}", new + again)  # some messages of the hour before come again
            job = IngestJob(spark, f"{root}/store", f"{root}/ckpt", dedup_watermark="50 minutes", rocksdb=True)
            job.run_available(read_event_stream(spark, f"{root}/in/*"))
            sizes.append(seen_keys(spark, f"{root}/ckpt").count())
        log = Counter(r.event_key for r in spark.read.parquet(job.paths["order_events"]).collect())
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert set(log.values()) == {1} and len(log) == 120
    assert max(sizes[2:]) <= 40, sizes  # of 120 keys seen


def test_lookup_opens_one_segment(spark):
    table = VersionedTable(spark, scratch_path(spark, "t-lookup"), "k string, v long", ["k"], F.pmod(F.xxhash64("k"), F.lit(16)))
    table.replace(spark.range(20_000).select(F.concat(F.lit("sku"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v")))
    found = table.lookup(k="sku777")
    assert [tuple(r) for r in found.collect()] == [("sku777", 777)]
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line)
    assert "EqualTo(k,sku777)" in scan
    assert table.lookup(k="none").count() == 0


def test_nested_items_in_chunks(spark):
    rng = random.Random(4)
    items = [(o, rng.randint(1, 3), f"s{rng.randint(0, 9)}", rng.randint(1, 5), Decimal(rng.randint(0, 999)) / 100, dt.datetime(2024, 1, rng.randint(1, 3)))
             for o in (1, 2, 2, 3) for _ in range(rng.randint(1, 6))] + [(9, 1, "hot", 1, Decimal("1.00"), dt.datetime(2024, 1, 1))] * 1050
    df = spark.createDataFrame(items, "order_id long, line_number int, sku string, qty int, line_total decimal(14,2), created_at timestamp_ntz").repartition(4)
    got = defaultdict(list)
    for r in nested_order_items(df, 100).collect():
        parsed = json.loads(r.items)
        assert len(parsed) == r.n_items <= 100
        got[r.order_id].append((r.chunk, parsed))
    for order, chunks in got.items():
        chunks.sort()
        assert [c for c, _ in chunks] == list(range(len(chunks))) and all(len(p) == 100 for _, p in chunks[:-1])
        flat = [i for _, p in chunks for i in p]
        mine = sorted((i for i in items if i[0] == order), key=lambda i: (i[5], i[1], i[2], i[3], i[4]))
        assert [(i["position"], i["sku"], i["qty"], Decimal(str(i["line_total"]))) for i in flat] == [(k, i[2], i[3], i[4]) for k, i in enumerate(mine, 1)]
    assert len(got[9]) == 11
