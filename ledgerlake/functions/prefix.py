"""Grouped running sums that stay balanced when one group is huge.

``sum(v) OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one task.
When one key may hold a third of all rows that task is the job.  Here rows
are range-partitioned on (g, o) instead, so a hot group is cut into
contiguous chunks on many tasks:

1. ``repartitionByRange(n, g, o)``; ``_pid`` = range partition index.
2. running sum inside each (``_pid``, g) chunk in one pass over the sorted
   partition, without another shuffle, written once as a table;
3. only a partition's first and last group can go on in another one: the totals of these
   chunks (two a partition at most) give each chunk's offset, a short table that is broadcast;
4. offset + local running sum = the group-wide running sum.

The order columns must make the order total (ties would make the chunk
cut, and therefore the running sums of tied rows, arbitrary).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)

from ..session import scratch_path, shuffle_partitions

#: Rows that one task sorts.
ROWS_PER_PARTITION = 1_000_000
_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_COMPARED = (*_WHOLE, BooleanType, DateType, DecimalType, StringType, TimestampType, TimestampNTZType)


def partitions_for(rows: DataFrame) -> int:
    """Range partitions for a table whose rows are cheap to count: at least the session's, more for many rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_PARTITION))


def grouped_prefix_sums(df: DataFrame, group: list[str], order: list[str], values: list[str],
                        suffix: str = "_before", num_partitions: int | None = None,
                        scratch: str | None = None, inner: dict[str, list[str]] | None = None, native: bool = False) -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over earlier rows (exclusive) of the
    same group, in ``order``, for every ``v`` in ``values``.  ``inner`` names further values that are
    summed within smaller groups, each the first columns of ``group + order``.  ``native`` asks for
    windows in place of the pass in Python: one more shuffle, but no Python on the executors.

    The range-partitioned chunk table is written once (under ``scratch``,
    default a fresh folder under ``spark.checkpoint.dir``) before offsets are
    joined back: ``repartitionByRange`` samples its input with a seed tied to
    the plan instance, so two un-shared evaluations could cut the chunks
    differently."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch or scratch_path(spark, "prefix")
    groups = {v: list(group) for v in values} | (inner or {})
    cut = df.repartitionByRange(n, *[F.col(c) for c in group + order]).withColumn("_pid", F.spark_partition_id())
    kinds: dict[str, DataType] = {f.name: f.dataType for f in df.schema}
    if not native and all(isinstance(kinds[v], _WHOLE) for v in groups) and all(isinstance(kinds[c], _COMPARED) for g in groups.values() for c in g):
        schema = StructType([*(StructField(f.name, f.dataType) for f in cut.schema), *(StructField(f"_loc_{v}", LongType()) for v in groups)])
        local = cut.sortWithinPartitions(*group, *order).mapInArrow(_running(groups), schema)
    else:
        at = lambda v: Window.partitionBy("_pid", *groups[v]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        local = cut.select("*", *[F.coalesce(F.sum(v).over(at(v)), F.lit(0)).alias(f"_loc_{v}") for v in groups])
    with shuffle_partitions(spark, n):  # what df has to shuffle, too
        local.write.parquet(path)
    out = local = spark.read.schema(local.schema).parquet(path)
    for k, by in enumerate({tuple(g): list(g) for g in groups.values()}.values()):
        own = [v for v in groups if groups[v] == by]
        offsets = _offsets(local, by, own)
        offsets.write.parquet(f"{path}-offsets-{k}")
        short = F.broadcast(spark.read.schema(offsets.schema).parquet(f"{path}-offsets-{k}").select(
            F.col("_pid").alias("_at"), *[F.col(c).alias(f"_g_{c}") for c in by], *[f"_off_{v}" for v in own]))
        same = F.col("_pid") == F.col("_at")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        out = out.join(short, same, "left").drop("_at", *[f"_g_{c}" for c in by])
    return out.select(*df.columns, *[(F.coalesce(F.col(f"_off_{v}"), F.lit(0)) + F.col(f"_loc_{v}")).alias(v + suffix) for v in groups])


def _offsets(local: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """What earlier partitions hold of the groups that begin or end a partition."""
    whole = F.struct(*by)
    edges = local.groupBy("_pid").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    edges = edges.select("_pid", F.explode(F.array_distinct(F.array("first", "last"))).alias("g")).select(F.col("_pid").alias("_at"), *[F.col(f"g.{c}").alias(f"_g_{c}") for c in by])
    same = F.col("_pid") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    totals = local.join(F.broadcast(edges), same, "left_semi").groupBy("_pid", *by).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return (totals.select("_pid", *by, F.row_number().over(Window.partitionBy(*by).orderBy("_pid")).alias("_nth"),
                          *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values])
            .where("_nth > 1").drop("_nth"))


def _running(groups: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running sums of each value within its group, over a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[str, tuple] = {}  # value -> group of the last row and its sum with that row
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sums = []
            for v, by in groups.items():
                new = np.zeros(n, bool)
                for c in by:
                    a, b = batch.column(c).slice(0, n - 1), batch.column(c).slice(1)
                    differ = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
                    new[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
                first = tuple(batch.column(c)[0].as_py() for c in by)
                group, carried = before.get(v, (None, 0))
                x = pc.fill_null(batch.column(v).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(x) - x
                start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                here = total - total[start]
                if first == group:
                    here[start == 0] += carried
                sums.append(pa.array(here, pa.int64()))
                before[v] = (tuple(batch.column(c)[n - 1].as_py() for c in by), int(here[-1] + x[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names, *(f"_loc_{v}" for v in groups)])

    return run
