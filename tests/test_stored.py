"""Versioned tables, mergeable distinct sets and the incrementally kept aggregates."""

import datetime as dt
import os
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import distinct_sets as ds
from ledgerlake.operators import inventory as inv
from ledgerlake.operators import receivables as ar
from ledgerlake.operators import sales
from ledgerlake.plans.catalogue import QueryRejected
from ledgerlake.plans.stored import AnalyticsStore
from ledgerlake.session import scratch_path
from ledgerlake.sources.tables import Warehouse
from ledgerlake.sources.versioned import VersionedTable, WrittenMeanwhile
from ledgerlake.streaming.incremental import HourlySales

from conftest import SF_SMALL


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark):
    return VersionedTable(spark, scratch_path(spark, "t-versioned"), "k long, v string", ["k"], F.floor(F.col("k") / 10))


def kv(spark, pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def test_merge_replaces_keys_and_keeps_other_segments(spark, table):
    assert table.version().number == 0 and table.read().count() == 0
    first = table.replace(kv(spark, [(k, "a") for k in range(30)]))
    old = table.read()
    second = table.merge(kv(spark, [(5, "b"), (25, "b"), (100, "b"), (None, "n")]))
    assert (first.number, second.number) == (1, 2)
    assert second.segments["1"] == first.segments["1"] and second.segments["0"] != first.segments["0"]
    want = {k: "a" for k in range(30)} | {5: "b", 25: "b", 100: "b", None: "n"}
    assert rows(table.read()) == Counter(want.items())
    assert sum(second.rows.values()) == 32 and second.rows["none"] == 1
    # A reader that began before the merge still has its version; so has one by number.
    assert rows(old) == Counter((k, "a") for k in range(30)) == rows(table.read(table.version(1)))
    table.merge(kv(spark, [(None, "m")]), keys=kv(spark, [(5, ""), (None, "")]))
    del want[5]
    assert rows(table.read()) == Counter((want | {None: "m"}).items())
    assert rows(table.read(segments=["2"])) == Counter((k, want[k]) for k in range(20, 30))


def test_crash_before_the_commit_changes_nothing(spark, table, monkeypatch):
    table.replace(kv(spark, [(1, "a")]))
    before = rows(table.read())

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(table.files, "put_new", crash)
    with pytest.raises(RuntimeError, match="lost"):
        table.merge(kv(spark, [(1, "b"), (2, "b")]), app="x", batch=3)
    monkeypatch.undo()
    assert table.version().number == 1 and rows(table.read()) == before
    # A file of a manifest that was not moved in place is not a version either.
    with open(os.path.join(table.path, "manifest", ".00000000000000000002.json-half"), "w") as f:
        f.write('{"number": 2')
    assert table.version().number == 1
    table.merge(kv(spark, [(1, "b"), (2, "b")]), app="x", batch=3)
    assert rows(table.read()) == Counter([(1, "b"), (2, "b")])
    # The folder of the crashed commit is an orphan that vacuum finds.
    folders = set(os.listdir(os.path.join(table.path, "data")))
    assert len(folders) == 3
    table.vacuum(keep=1, older_than_ms=1 << 60)
    assert len(os.listdir(os.path.join(table.path, "data"))) == 1 and rows(table.read()) == Counter([(1, "b"), (2, "b")])


def test_vacuum_spares_young_folders(spark, table):
    table.replace(kv(spark, [(1, "a")]))
    os.makedirs(os.path.join(table.path, "data", "underway"))
    table.replace(kv(spark, [(1, "b")]))
    os.utime(os.path.join(table.path, "data", "underway"))
    table.vacuum(keep=1)
    assert "underway" in os.listdir(os.path.join(table.path, "data"))


def test_batches_apply_once_and_writers_collide(spark, table):
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.concat_ws("", F.array_sort(F.collect_list("v"))).alias("v"))
    for batch in (0, 1, 1, 0):
        table.merge(kv(spark, [(1, "x"), (11, "y")]), add, app="s", batch=batch)
    assert rows(table.read()) == Counter([(1, "xx"), (11, "yy")]) and table.version().number == 2
    table.merge(kv(spark, []), add, app="s", batch=2)  # nothing to do is remembered too
    assert table.version().applied == {"s": 2} and table.version().number == 3
    other = VersionedTable(spark, table.path, "k long, v string", ["k"], F.floor(F.col("k") / 10))
    write = table._write

    def slow(df):
        out = write(df)
        other.merge(kv(spark, [(1, "first")]))
        return out

    table._write = slow
    with pytest.raises(WrittenMeanwhile):
        table.merge(kv(spark, [(1, "second")]))
    assert rows(table.read()) == Counter([(1, "first"), (11, "yy")])


def test_sets_merge_exactly(spark):
    rng = random.Random(2)
    ids = ["0", "7", "07", "+7", "32768", "32769", "65536", str(ds.BITMAP_IDS - 1), str(ds.BITMAP_IDS), "9" * 30, "a", "", "-1", None]
    pairs = [(rng.randint(0, 2), rng.choice(ids)) for _ in range(200)] + [(9, None)]
    half = spark.createDataFrame(pairs[:90], "g int, id string"), spark.createDataFrame(pairs[70:], "g int, id string")
    merged = ds.merged_sets(ds.id_sets(half[0], ["g"], "id"), ds.id_sets(half[1], ["g"], "id"), ["g"])
    want = defaultdict(set)
    for g, i in pairs:
        if i is not None:
            want[g].add(i)
    assert {r.g: r.n for r in ds.set_sizes(merged, ["g"], "n").collect()} == {g: len(s) for g, s in want.items()}


EVENT = "id long, order_id long, event_type string, customer_id string, total_amount decimal(14,2), status string, event_timestamp timestamp_ntz"


def events(spark, n, seed, start=0, hours=60):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 30)
    data = [(start + i, start + i, rng.choice(["order_created"] * 4 + ["order_updated"]), rng.choice([None, "x", *map(str, range(20))]),
             Decimal(rng.randint(0, 9999)) / 100, "placed", t0 + dt.timedelta(minutes=rng.randint(0, hours * 60))) for i in range(n)]
    return spark.createDataFrame(data, EVENT)


def test_incremental_hours_equal_the_rollup(spark):
    hourly = HourlySales(spark, scratch_path(spark, "t-hourly"))
    parts = [events(spark, 150, 1), events(spark, 0, 2), events(spark, 40, 3, 1000, 3), events(spark, 90, 4, 2000)]
    so_far = parts[0].limit(0)
    for batch, part in enumerate(parts):
        hourly.apply(part, "s", batch)
        hourly.apply(part, "s", batch)  # a retry
        so_far = so_far.unionByName(part)
        assert rows(hourly.read()) == rows(sales.sales_by_hour(so_far))
    hourly.rebuild(parts[0])
    assert rows(hourly.read()) == rows(sales.sales_by_hour(parts[0]))
    hourly.apply(parts[0], "s", 3)  # still known
    assert rows(hourly.read()) == rows(sales.sales_by_hour(parts[0]))


def test_crash_between_the_two_commits(spark, monkeypatch):
    hourly = HourlySales(spark, scratch_path(spark, "t-hourly"))
    a, b = events(spark, 80, 5), events(spark, 60, 6, 500)
    hourly.apply(a, "s", 0)

    def crash(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(hourly.hours, "merge", crash)
    with pytest.raises(RuntimeError):
        hourly.apply(b, "s", 1)
    monkeypatch.undo()
    assert rows(hourly.read()) == rows(sales.sales_by_hour(a))
    hourly.apply(b, "s", 1)
    assert rows(hourly.read()) == rows(sales.sales_by_hour(a.unionByName(b)))


def test_a_batch_reads_only_the_segments_it_touches(spark, monkeypatch):
    """State of untouched days is not read, and the log not at all."""
    hourly = HourlySales(spark, scratch_path(spark, "t-hourly"))
    hourly.apply(events(spark, 400, 7, hours=24 * 20), "s", 0)
    asked = []
    read = VersionedTable.read

    def watched(self, version=None, segments=None):
        asked.append((self.path.rsplit("/", 1)[1], None if segments is None else sorted(segments)))
        return read(self, version, segments)

    monkeypatch.setattr(VersionedTable, "read", watched)
    before = hourly.customers.version()
    hourly.apply(events(spark, 50, 8, 9000, hours=1), "s", 1)
    monkeypatch.undo()
    assert {a for a in map(str, asked)} == {"('hour_customers', ['2024-01-30'])", "('sales_by_hour', ['2024-01'])"}
    after = hourly.customers.version()
    assert {s for s in after.segments if after.segments[s] != before.segments.get(s)} == {"2024-01-30"}


def test_stock_and_aging_refresh(spark):
    w = Warehouse(spark, SF_SMALL)
    store = AnalyticsStore(spark, scratch_path(spark, "t-store"))
    as_of = "2001-08-02"
    store.rebuild(w, as_of)
    full = rows(store.stock.read())
    assert full == rows(inv.stock_snapshot(w.products, w.inventory_items))
    assert rows(store.sales.read()) == rows(sales.sales_by_hour(w.order_events))
    assert rows(store.aging.read()) == rows(ar.ar_aging(w.invoices, w.orders, w.customers, as_of))
    # Stock sold out, one SKU gone; everything paid by customers 1 and 2.
    items = w.inventory_items.where("sku <> '5'").withColumn("qty_on_hand", F.when(F.col("sku") == "3", 0).otherwise(F.col("qty_on_hand")))
    store.refresh_stock(w.products, items, spark.createDataFrame([("3",), ("5",), ("3",), ("none",)], "sku string"))
    assert rows(store.stock.read()) == rows(inv.stock_snapshot(w.products, items))
    mine = w.orders.where("customer_id IN (1, 2)").select(F.col("id").alias("order_id"))
    paid = w.invoices.join(mine.withColumn("p", F.lit(True)), "order_id", "left").withColumn("status", F.when(F.col("p"), "paid").otherwise(F.col("status"))) \
        .select(*w.invoices.columns)
    store.refresh_aging(w.customers, w.orders, paid, spark.createDataFrame([(1,), (2,)], "customer_id long"), as_of)
    want = ar.ar_aging(paid, w.orders, w.customers, as_of)
    assert rows(store.aging.read()) == rows(want)
    assert rows(store.query("overdue_ar", 1000, as_of=as_of)) == rows(ar.overdue_ar(want, as_of, 1000))
    assert store.query("low_stock", 3).count() == 3
    with pytest.raises(QueryRejected):
        store.query("low_stock", 1001)
    with pytest.raises(QueryRejected):
        store.query("drop_tables")
    store.vacuum(keep=1)
    assert rows(store.aging.read()) == rows(want)


def test_a_hot_segment_is_written_by_many_tasks(spark):
    table = VersionedTable(spark, scratch_path(spark, "t-hot"), "k long, v string", ["k"])
    rows_ = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x" * 50).alias("v")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's
    try:
        table.replace(rows_)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(table.read().inputFiles()) > 1
