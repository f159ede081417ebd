"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

__all__ = ["broadcast_if_small", "drop_shuffles", "give_back", "key_and_text", "lean", "rewritten", "slices", "scratch_path", "table", "one_of_repeats"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def key_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key as long and the text (null stays null): other columns,
    whatever their names, don't take part."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def rewritten(df: DataFrame, name: str, *, partition: tuple = ()) -> DataFrame:
    """Write to a fresh folder under ``spark.checkpoint.dir`` and read back:
    cuts the lineage, and a lost executor costs only the tasks it ran."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects the steps'
    plans as garbage, which by itself may come long after the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a table of a few numbers each that is broadcast (some 50 MB with its hash table).
MOST_BROADCAST = 500_000


def broadcast_if_small(written: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most ``most``; a
    larger one is left to an ordinary join."""
    return F.broadcast(written) if written.count() <= most else written


ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return memory that is free, but held by Arrow's pool and the C library, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn: ArrowMap) -> ArrowMap:
    """A map after which its worker, which Spark keeps for later tasks, is as small as before."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: what is made of a batch as Python objects stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def one_of_repeats(docs: DataFrame, repeated: Column, key: list[Column]) -> DataFrame:
    """All rows where ``repeated`` does not hold, and of the others one for
    each ``key`` (they agree in it; the first by their whole row's hash stays)."""
    names = docs.columns
    packed = docs.select(F.struct("*").alias("row"), repeated.alias("repeated"), F.struct(*key).alias("key"))
    plain = packed.where(~F.col("repeated")).select("row")
    rest = (packed.where("repeated").groupBy("key")
            .agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return plain.unionByName(rest).select(*[F.col(f"row.`{n}`") for n in names])
