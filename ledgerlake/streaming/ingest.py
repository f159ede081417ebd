"""Structured Streaming ingest of domain events.

Source: JSON-lines files of ``(subject, data)`` messages (in production the
same DataFrame comes from ``readStream.format("kafka")``).  Per micro-batch
(``foreachBatch``):

1. decode, drop already-seen event keys (stream-level ``dropDuplicates`` =
   the idempotency set, kept in the state store; optionally bounded with a
   watermark via ``dropDuplicatesWithinWatermark``);
2. append the three event logs, partitioned by (event_date, batch_id) with
   dynamic partition overwrite, so a retried batch replaces its own files;
3. quarantine undecodable messages instead of redelivering them forever;
4. recompute ``sales_by_hour`` for the dates touched by the batch from the
   whole log (exact distinct customers, no lateness bound) and overwrite just
   those ``sales_date`` partitions; the range of touched dates prunes the log;
5. optionally generate invoices + ledger postings for newly created orders
   (anti-join against invoices already written);
6. optionally reserve stock for orders whose parts are all there (all-or-nothing, in
   arrival order, against base stock plus earlier batches' reservations) and
   publish ``stock_reserved`` / ``reservation_failed`` messages to an outbox.

The roles can run as separate consumers of the same stream (as the source
system's analytics, billing and inventory services do): ``analytics``,
``billing`` and ``inventory`` switch them on independently.

Checkpoints and tables live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import post_invoices
from ..operators.sales import sales_by_hour
from ..schemas import PAYMENT_TERMS_DAYS, RAW_EVENT
from ..session import drop_folder, drop_shuffles, scratch_path
from ..sources import events as ev
from ..sources.sinks import overwrite_partitions

log = logging.getLogger(__name__)

#: Rows of a batch that one task writes to a log.
ROWS_PER_FILE = 1_000_000
#: What a reservation needs of a message.
RESERVED_FROM = ["order_id", "event_timestamp", "part", "parts", "items"]


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of raw messages from JSON-lines files under ``path``."""
    r = spark.readStream.schema(RAW_EVENT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.json(path)


def write_messages(messages: DataFrame, path: str, n_files: int | None = None, compression: str = "none") -> None:
    """Write messages as JSON-lines files (a file drop for the file source), one for
    each partition that the messages have, or ``n_files``.  A ``gzip`` file is read by one task, but takes
    less than a tenth of the disk."""
    (messages.repartition(n_files) if n_files else messages).write.mode("append").option("compression", compression).json(path)


def dedup_stream(decoded: DataFrame, watermark: str | None = None) -> DataFrame:
    """Drop messages whose event key was already seen.  Without a watermark
    the key set is unbounded (exact); with one, keys are forgotten once the
    event time passes the watermark."""
    if watermark is None:
        return decoded.dropDuplicates(["event_key"])
    return (decoded.withColumn("_evt_ts", F.col("event_timestamp").cast("timestamp"))
            .withWatermark("_evt_ts", watermark)
            .dropDuplicatesWithinWatermark(["event_key"])
            .drop("_evt_ts"))


#: Spark's state store on local disk, with changelogs under the checkpoint: keys don't take heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_STORE = "spark.sql.streaming.stateStore"
#: The memory of all partitions' stores on an executor is bounded together, and rows aren't looked up once more to be counted.
#: Stores of ended streams, some MB of disk each however few their rows, go at the next maintenance.
ROCKSDB_CONF = {f"{_STORE}.providerClass": ROCKSDB, f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
                f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.maxMemoryUsageMB": "256",
                f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false", f"{_STORE}.maintenanceInterval": "10s"}


@contextmanager
def in_rocksdb(spark: SparkSession, on: bool = True):
    """Streams started in here keep their state (the set of seen keys, above all) in RocksDB, if ``on``; those
    of the session that are started later don't.  A stream that goes on keeps the kind of store that it began with."""
    old = {k: spark.conf.get(k, None) for k in ROCKSDB_CONF} if on else {}
    for k in old:
        spark.conf.set(k, ROCKSDB_CONF[k])
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def seen_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys that a deduplicating stream remembers now, read back from its state (operator 0)."""
    return spark.read.format("statestore").load(checkpoint).select("key.*")


def touched_log(spark: SparkSession, log_path: str, touched: DataFrame) -> DataFrame:
    """The order log restricted to the touched dates: the range of dates (one
    row) prunes folders at planning, the semi-join drops the dates between."""
    first, last = touched.agg(F.min("event_date"), F.max("event_date")).first()
    log_rows = spark.read.parquet(log_path).filter(F.col("event_date").between(F.lit(first), F.lit(last)))
    return log_rows.join(touched, "event_date", "left_semi")


def refresh_sales(spark: SparkSession, order_log_path: str, sales_path: str, touched: DataFrame) -> None:
    """Recompute the hourly rollup for the touched dates and overwrite only
    their ``sales_date`` partitions."""
    part = touched_log(spark, order_log_path, touched)
    out = sales_by_hour(part).withColumn("sales_date", F.to_date("hour"))
    overwrite_partitions(out, sales_path, "sales_date")


def invoices_for_new_orders(created: DataFrame, existing: DataFrame | None,
                            terms_days: int = PAYMENT_TERMS_DAYS) -> DataFrame:
    """One invoice per distinct newly created order: amount = order total,
    issued at the event time, due ``terms_days`` later."""
    new = created.select("order_id", "total_amount", "event_timestamp")
    if existing is not None:
        new = new.join(existing.select("order_id"), "order_id", "left_anti")
    # An order published twice is invoiced by its earliest message.
    new = (new.groupBy("order_id").agg(F.min(F.struct("event_timestamp", "total_amount")).alias("m"))
           .select("order_id", "m.total_amount", "m.event_timestamp"))
    return new.select(
        F.col("order_id").alias("id"), "order_id", F.col("total_amount").alias("amount"),
        F.lit("issued").alias("status"), F.col("event_timestamp").alias("issued_at"),
        F.date_add(F.to_date("event_timestamp"), terms_days).alias("due_date"))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if nothing has been written yet; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass
class IngestJob:
    spark: SparkSession
    store: str                   # root folder of the analytics tables
    checkpoint: str              # streaming checkpoint folder
    dedup_watermark: str | None = None
    analytics: bool = True               # event logs, quarantine, sales rollup refresh
    billing: bool = False                # invoices + ledger postings for new orders
    inventory: DataFrame | None = None   # base stock; set to reserve stock for new orders
    # "event": drop repeated event keys.  "order": one message per (subject,
    # order id) is kept in the state store, so a consumer acting per order
    # (billing) needs no lookup of what earlier batches already produced.
    idempotency: str = "event"
    # Seen keys in RocksDB instead of the executors' heap; with ``dedup_watermark`` they are bounded in time, too.
    rocksdb: bool = False

    @property
    def paths(self) -> dict[str, str]:
        return {n: f"{self.store}/{n}" for n in
                ("order_events", "stock_events", "invoice_events", "quarantine", "sales_by_hour",
                 "invoices", "ledger_entries", "reservations", "reserved_qty", "outbox", "pending")}

    @property
    def _only_reserves(self) -> bool:
        return self.inventory is not None and not self.analytics and not self.billing

    def _append(self, df: DataFrame, name: str, batch_id: int, parts=("event_date", "batch_id"), files: int = 1) -> None:
        overwrite_partitions(df.withColumn("batch_id", F.lit(batch_id)), self.paths[name], *parts, files=files, deal=parts != ("batch_id",))

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        if self._only_reserves:
            self._reserve(spark, batch, batch_id)  # it writes the batch's messages once and reads nothing else of it
            return
        batch = batch.persist()
        t0 = time.perf_counter()
        try:
            orders = ev.order_log_rows(batch)
            created = orders.filter(F.col("event_type") == "order_created")
            if self.analytics:
                # A batch of one date is dealt to several tasks.
                files = -(-batch.count() // ROWS_PER_FILE) or 1
                self._append(orders, "order_events", batch_id, files=files)
                self._append(ev.stock_log_rows(batch), "stock_events", batch_id, files=files)
                self._append(ev.invoice_log_rows(batch), "invoice_events", batch_id, files=files)
                self._append(ev.quarantine_rows(batch), "quarantine", batch_id, parts=("batch_id",))
                log.debug("batch %d: logs %.2fs", batch_id, time.perf_counter() - t0)
            if self.inventory is not None:
                self._reserve(spark, batch, batch_id)
            # A scalar existence check, not a collect of the dates.
            if created.limit(1).count() == 0:
                return
            if self.analytics:
                touched = created.select("event_date").distinct()
                refresh_sales(spark, self.paths["order_events"], self.paths["sales_by_hour"], touched)
                log.debug("batch %d: sales refresh %.2fs", batch_id, time.perf_counter() - t0)
            if self.billing:
                self._bill(spark, created, batch_id)
            log.debug("batch %d: done %.2fs", batch_id, time.perf_counter() - t0)
        finally:
            batch.unpersist()

    def _bill(self, spark: SparkSession, created: DataFrame, batch_id: int) -> None:
        existing = None
        if self.idempotency != "order":
            existing = _read_or_none(spark, self.paths["invoices"])
            if existing is not None:
                existing = existing.filter(F.col("batch_id") != batch_id)
        inv = invoices_for_new_orders(created, existing).withColumn("batch_id", F.lit(batch_id))
        inv.write.mode("overwrite").partitionBy("batch_id").parquet(self.paths["invoices"])
        written = spark.read.parquet(self.paths["invoices"]).filter(F.col("batch_id") == batch_id)
        (post_invoices(written).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").partitionBy("batch_id").parquet(self.paths["ledger_entries"]))

    def _reserve(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        """All-or-nothing reservation of the orders whose parts are all there, in arrival
        order, against base stock plus what earlier batches reserved.  Parts of
        orders that are not complete yet wait in the ``pending`` table (each batch writes
        what still waits).  Only the SKUs of these orders are read (semi-joins), and an
        order decided in an earlier batch is not reserved again."""
        from ..functions.prefix import partitions_for
        from ..operators.reservation import ADMITTED, sequential_admission
        path = scratch_path(spark, "reserve-batch")

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            drop_shuffles(spark)
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        messages = batch.filter(F.col("is_valid") & (F.col("event_type") == "order_created")).select(*RESERVED_FROM)
        waiting = _read_or_none(spark, self.paths["pending"])
        if waiting is not None:
            last = waiting.filter(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
            messages = messages.unionByName(waiting.filter(F.col("batch_id") == last).select(*messages.columns))
        decided = _read_or_none(spark, self.paths["reservations"])
        if decided is not None:
            messages = messages.join(decided.filter(F.col("batch_id") != batch_id).select("order_id"),
                                     "order_id", "left_anti")
        # Written once: the batch's own part of the stream is not computed again for each use.
        messages = written(messages.dropDuplicates(["order_id", "part"]), "messages")
        seen = messages.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("of"),
                                                F.min("event_timestamp").alias("arrival"))
        seen = written(seen, "seen")
        # A marker row (no order) makes the batch's folder exist when nothing waits.
        held = messages.join(seen.filter("n < of").select("order_id"), "order_id", "left_semi")
        marker = spark.createDataFrame([(None,)], "order_id string").select(
            *[F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in messages.columns])
        overwrite_partitions(held.unionByName(marker).withColumn("batch_id", F.lit(batch_id)), self.paths["pending"], "batch_id", deal=False)
        orders = seen.filter("n >= of").select("order_id", "arrival")
        if orders.limit(1).count() == 0:
            drop_folder(spark, path)
            return
        # Lines are taken from the messages before they are joined: a line is short, a message isn't.
        # Orders of one time are decided in the order of their ids, as numbers where they are such.
        items = written(ev.items_of(messages).select("order_id", "position", "sku", "qty").join(orders, "order_id")
                        .withColumn("number", F.col("order_id").try_cast("long")), "items")
        skus = items.select(F.col("sku").alias("key")).distinct()
        base = self.inventory.select(
            F.col("sku").alias("key"),
            (F.col("qty_on_hand") - F.col("reserved_qty")).cast("long").alias("x0")).join(skus, "key", "left_semi")
        taken = _read_or_none(spark, self.paths["reserved_qty"])
        if taken is not None:
            used = (taken.filter(F.col("batch_id") != batch_id).join(skus, F.col("sku") == F.col("key"), "left_semi")
                    .groupBy(F.col("sku").alias("key")).agg(F.sum("qty").alias("used")))
            base = base.join(used, "key", "left").select(
                "key", (F.col("x0") - F.coalesce(F.col("used"), F.lit(0))).alias("x0"))
        state = base.select("key", "x0", F.lit(0).cast("long").alias("floor"))
        lines = items.select(F.col("order_id").alias("txn_id"), F.col("sku").alias("key"),
                             (-F.col("qty").cast("long")).alias("delta"), "arrival", "number")
        dec = sequential_admission(lines, state, ["arrival", "number"], partitions=partitions_for(items), scratch=f"{path}/admission")
        drop_shuffles(spark)
        # An order without lines reserves nothing and is admitted.
        decisions = (orders.join(dec.select(F.col("txn_id").alias("order_id"), "decision", "reason"), "order_id", "left")
                     .select("order_id", "arrival", F.coalesce(F.col("decision") == ADMITTED, F.lit(True)).alias("reserved"),
                             F.when(F.col("reason") == "unknown_key", "unknown_sku")
                              .when(F.col("reason") == "insufficient", "insufficient_stock").alias("reason"))
                     .withColumn("batch_id", F.lit(batch_id)))
        overwrite_partitions(decisions, self.paths["reservations"], "batch_id", deal=False)
        dec_t = spark.read.parquet(self.paths["reservations"]).filter(F.col("batch_id") == batch_id)
        per_line = items.drop("arrival", "number").join(dec_t.select("order_id", "reserved", "reason", "arrival"), "order_id")
        admitted = per_line.filter("reserved").groupBy("sku").agg(F.sum("qty").cast("long").alias("qty"))
        overwrite_partitions(admitted.withColumn("batch_id", F.lit(batch_id)), self.paths["reserved_qty"], "batch_id", deal=False)
        # Publish the outcome as messages (one per line): the outbox is the
        # broker-facing sink; the analytics consumer ingests it like any event.
        outcome = F.when(F.col("reserved"), "stock_reserved").otherwise("reservation_failed")
        msgs = ev.emit(per_line, outcome, {
            "event_id": F.concat_ws(":", outcome, F.col("order_id"), F.col("position").cast("string"), F.col("sku")),
            "order_id": F.col("order_id"),
            "sku": F.col("sku"),
            "qty_reserved": F.when(F.col("reserved"), F.col("qty")).otherwise(0),
            "reason": F.col("reason"),
            "timestamp": ev.iso(F.col("arrival")),
        })
        overwrite_partitions(msgs.withColumn("batch_id", F.lit(batch_id)), self.paths["outbox"], "batch_id", deal=False)
        drop_folder(spark, path)
        drop_shuffles(spark)

    def rebuild_sales(self) -> None:
        """Rebuild the hourly rollup from the whole order log (every date is
        "touched") into a table beside the live one; the same batch function as the
        incremental refresh."""
        out = sales_by_hour(self.spark.read.parquet(self.paths["order_events"])).withColumn("sales_date", F.to_date("hour"))
        (out.repartition("sales_date").write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("sales_date").parquet(self.paths["sales_by_hour"] + "_rebuilt"))

    def start(self, raw_stream: DataFrame, available_now: bool = True,
              processing_time: str | None = None) -> StreamingQuery:
        decoded = ev.decode_events(raw_stream)
        if self.idempotency == "order":
            decoded = decoded.withColumn("event_key", F.coalesce(
                F.concat_ws(":", F.col("subject"), F.col("order_id").cast("string")), F.col("event_key")))
        if self._only_reserves:  # the messages' text isn't dealt with the rest
            decoded = decoded.select("event_key", "event_type", "is_valid", *RESERVED_FROM)
        decoded = dedup_stream(decoded, self.dedup_watermark)
        w = (decoded.writeStream.foreachBatch(self.process_batch)
             .option("checkpointLocation", self.checkpoint))
        if available_now:
            w = w.trigger(availableNow=True)
        elif processing_time:
            w = w.trigger(processingTime=processing_time)
        with in_rocksdb(self.spark, self.rocksdb):
            return w.start()

    def run_available(self, raw_stream: DataFrame) -> None:
        """Process everything currently in the source, then stop."""
        q = self.start(raw_stream, available_now=True)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


def windowed_sales(decoded_stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """The other streaming form of the hourly rollup: tumbling 1-hour event
    time windows with a watermark (update output mode).  Events later than
    the watermark are dropped, unlike the touched-date refresh."""
    created = (decoded_stream.filter(F.col("event_type") == "order_created")
               .withColumn("_ts", F.col("event_timestamp").cast("timestamp"))
               .withWatermark("_ts", watermark))
    return (created.groupBy(F.window("_ts", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 F.sum("total_amount").cast("decimal(24,2)").alias("total_revenue"),
                 F.approx_count_distinct("customer_id").alias("approx_unique_customers"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "total_orders", "total_revenue",
                    "approx_unique_customers"))
