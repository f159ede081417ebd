"""Append-only event logs with row ids, compacted under versions.

A log is a versioned table (``sources.versioned``) whose segments are the parts that batches
appended, by date.  Every row gets ``id``, gapless from 1 in order of batches, and
``processed_at``.  The highest id is the number of rows that the manifest counts, so the mark
and the rows become visible in one step, and a batch that is appended again after a crash starts at
the same id.

``compact`` merges the small parts of a date into one and swaps them in a new version: a
reader goes on with the files of its own version, and neither appending nor compacting
undoes the other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .versioned import Version, VersionedTable, WrittenMeanwhile

#: Row numbers inside a partition are the low bits of Spark's increasing ids.
_ROW_BITS = (1 << 33) - 1
#: Times that a commit is moved on to a version that was written meanwhile.
TRIES = 20


def with_row_ids(rows: DataFrame, after: int) -> DataFrame:
    """``id`` from ``after`` + 1 without gaps: each partition's rows are counted, and a partition begins
    behind those before it.  No row changes its partition, and the window has a row a partition.
    The rows are written once, as a second evaluation could deal them differently."""
    spark = rows.sparkSession
    path = scratch_path(spark, "row-ids")
    rows.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_pid").count().collect())  # a row a partition
    starts, at = [], after
    for pid, n in sizes:
        starts.append((pid, at))
        at += n
    begin = spark.createDataFrame(starts, "_pid int, _begin long")
    return dealt.join(F.broadcast(begin), "_pid").select((F.col("_begin") + F.col("_at") + 1).alias("id"), *rows.columns)


class EventLog(VersionedTable):
    """``schema`` has the columns of the appended rows, among them the date ``day``."""

    def __init__(self, spark: SparkSession, path: str, schema, day: str = "event_date"):
        fields = spark.createDataFrame([], schema).schema
        full = StructType([*spark.createDataFrame([], "id long").schema, *fields, *spark.createDataFrame([], "processed_at timestamp_ntz").schema])
        super().__init__(spark, path, full, ["id"], F.col(day))
        self.columns = fields.names

    def _swap(self, change, app: str | None = None, batch: int | None = None) -> Version:
        """Commit ``change(segments, rows)`` over the newest version, again if another writer was faster."""
        for _ in range(TRIES):
            base = self.version()
            if self._done(base, app, batch):
                return base
            segments, rows = change(dict(base.segments), dict(base.rows))
            try:
                return self._commit(base, segments, rows, app, batch)
            except WrittenMeanwhile:
                continue
        raise WrittenMeanwhile(f"{TRIES} times, {self.path}")

    def append(self, rows: DataFrame, app: str, batch: int, processed_at: dt.datetime) -> Version:
        """Append a batch once; a log has one appender (and any number of readers, and a compactor)."""
        base = self.version()
        if self._done(base, app, batch):
            return base
        numbered = with_row_ids(rows.select(*self.columns), sum(base.rows.values()))
        folders, counts = self._write(numbered.withColumn("processed_at", F.lit(processed_at).cast("timestamp_ntz")))
        label = lambda day: f"{day}@{app}-{batch:012d}"
        return self._swap(lambda s, n: (s | {label(d): f for d, f in folders.items()}, n | {label(d): c for d, c in counts.items()}), app, batch)

    def between(self, first: str | None = None, last: str | None = None, version: Version | None = None) -> DataFrame:
        """Rows of a range of dates (ISO text); parts of other dates aren't opened."""
        version = version or self.version()
        wanted = [s for s in version.segments if (first is None or s[:10] >= first) and (last is None or s[:10] <= last)]
        return self.read(version, wanted)

    def compact(self, most_parts: int = 8) -> Version:
        """Merge the parts of every date that has more than ``most_parts``: the files of a date stay bounded."""
        base = self.version()
        by_day: dict[str, list[str]] = {}
        for label in base.segments:
            by_day.setdefault(label.split("@")[0], []).append(label)
        old = sorted(label for labels in by_day.values() if len(labels) > most_parts for label in labels)
        if not old:
            return base
        folders, counts = self._write(self.read(base, old))
        merged = {f"{d}@merged-{base.number:012d}": f for d, f in folders.items()}
        sizes = {f"{d}@merged-{base.number:012d}": c for d, c in counts.items()}

        def change(segments, rows):
            if not set(old) <= set(segments):  # another compactor had them
                return segments, rows
            return ({s: f for s, f in segments.items() if s not in old} | merged, {s: n for s, n in rows.items() if s not in old} | sizes)

        return self._swap(change)
