"""What a watermark drops, reported and kept.

Spark's own watermark discards late rows without a trace.  Here a micro-batch is split by the
watermark that the batches before it set (their newest event time less the allowed delay): a row
is late if its hour ended by then, as for a windowed aggregate.  Rows in time go into the hourly
sales (``streaming.incremental``); late ones are written beside them, with a report row for each batch.

The newest event time is a versioned table that is committed last, with the batch's id.  A batch
that runs again starts from the version before it, splits in the same way and replaces its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timefns import trunc_ntz
from ..sources import events as ev
from ..sources.sinks import overwrite_partitions
from ..sources.versioned import VersionedTable
from .incremental import HourlySales
from .ingest import dedup_stream

APP = "windowed"


@dataclass
class WindowedSales:
    spark: SparkSession
    store: str
    checkpoint: str
    delay_minutes: int = 120

    def __post_init__(self) -> None:
        self.sales = HourlySales(self.spark, self.store)
        self.newest = VersionedTable(self.spark, f"{self.store}/newest", "newest timestamp_ntz", ["newest"])

    def late_rows(self) -> DataFrame:
        return self._read("late_rows", "order_id string, customer_id string, total_amount decimal(14,2), event_timestamp timestamp_ntz, batch_id int")

    def report(self) -> DataFrame:
        """Per batch: the watermark it met (null: none yet), rows in time and rows dropped."""
        return self._read("late_report", "watermark timestamp_ntz, in_time long, dropped long, batch_id int")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.newest.files.names(f"{self.store}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.store}/{name}")

    def process_batch(self, decoded: DataFrame, batch: int) -> None:
        rows = ev.order_log_rows(decoded).where("event_type = 'order_created'").persist()
        try:
            newest = self.newest.read(self.newest.before(APP, batch)).agg(F.max("newest")).first()[0]
            mark = F.timestamp_add("MINUTE", F.lit(-self.delay_minutes), F.lit(newest).cast("timestamp_ntz"))
            ends = F.timestamp_add("HOUR", F.lit(1), trunc_ntz("hour", F.col("event_timestamp")))
            late = F.coalesce(ends <= mark, F.lit(False))
            in_time = rows.where(~late)
            self.sales.apply(in_time, APP, batch)
            named = lambda df: df.withColumn("batch_id", F.lit(batch))
            overwrite_partitions(named(rows.where(late).select("order_id", "customer_id", "total_amount", "event_timestamp")),
                                 f"{self.store}/late_rows", "batch_id", deal=False)
            counts = rows.agg(F.count_if(~late).alias("in_time"), F.count_if(late).alias("dropped"))
            overwrite_partitions(named(counts.select(mark.alias("watermark"), "in_time", "dropped")), f"{self.store}/late_report", "batch_id", deal=False)
            seen = rows.agg(F.max("event_timestamp").alias("newest")).select(F.greatest("newest", F.lit(newest).cast("timestamp_ntz")).alias("newest"))
            self.newest.replace(seen, app=APP, batch=batch)
        finally:
            rows.unpersist()

    def start(self, raw_stream: DataFrame) -> StreamingQuery:
        decoded = dedup_stream(ev.decode_events(raw_stream))
        return (decoded.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True).start())

    def run_available(self, raw_stream: DataFrame) -> None:
        query = self.start(raw_stream)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
