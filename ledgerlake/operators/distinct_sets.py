"""Exact distinct counts that merge: sets of ids as bitmaps.

A set per group is a handful of rows: ids that are numbers below ``BITMAP_IDS`` are bits of
fixed-size bitmaps (32,768 ids each, the ``bitmap_*`` functions), any other id is a row of its
own.  Sets of the same group merge by OR, so a group's distinct count is kept
exactly without its raw rows, and one group is never gathered in one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers from here on are rows of their own: bitmaps pay where ids are dense.
BITMAP_IDS = 1 << 31
SET_COLUMNS = "bucket long, member string, bitmap binary"


def id_sets(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """(group, bucket, member, bitmap) rows of the distinct non-null ids per group."""
    text = F.col(member).cast("string")
    # Only the canonical decimal form, so that "7" and "07" stay different ids.
    number = F.when(text.rlike("^(0|[1-9][0-9]{0,9})$"), text.cast("long"))
    number = F.when(number < BITMAP_IDS, number)
    spread = rows.where(F.col(member).isNotNull()).select(
        *group, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"), F.when(number.isNull(), text).alias("member"))
    bits = spread.where("member IS NULL").groupBy(*group, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap")) \
        .select(*group, "bucket", F.lit(None).cast("string").alias("member"), "bitmap")
    others = spread.where("member IS NOT NULL").select(*group, "bucket", "member").distinct().withColumn("bitmap", F.lit(None).cast("binary"))
    return bits.unionByName(others)


def merged_sets(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    both = a.select(*group, "bucket", "member", "bitmap").unionByName(b.select(*group, "bucket", "member", "bitmap"))
    merged = both.groupBy(*group, "bucket", "member").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.withColumn("bitmap", F.when(F.col("member").isNull(), F.col("bitmap")))


def set_sizes(sets: DataFrame, group: list[str], name: str) -> DataFrame:
    """Distinct ids per group."""
    size = F.sum(F.coalesce(F.bitmap_count("bitmap"), F.lit(0))) + F.count("member")
    return sets.groupBy(*group).agg(size.cast("long").alias(name))
