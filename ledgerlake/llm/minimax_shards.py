"""Sharding by minimax contiguous partition.

Atomic groups are the hash cells of the texts: equal texts fall into one cell,
and cells are ordered by their number.  The table of cell sizes has at most
``CELLS`` rows whatever the corpus holds, so the driver can search it: a binary
search finds the smallest capacity for which greedy filling needs no more than
the given number of shards.  The cuts are made at that capacity.

Everything else is DataFrame work without Python: the cells are summed with
map-side aggregation (a text that a third of all rows repeat is one row per
task), the shard of a row is a comparison of its cell with the cuts, and the
slot is a running count on a range partitioning, which cuts a hot shard or a
hot text over many tasks.

Defined cases: a null text counts as the empty text (size 16, checksum 0); a
null key sorts first; rows that repeat a key get adjoining slots; an empty table
gives no rows; columns other than key and text play no part.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import grouped_prefix_sums
from .common import key_and_text, scratch_path

#: Cells of the text hash; the driver holds this many sizes at most (4 MB).
CELL_BITS = 18
ROW_BYTES = 16


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which ``sizes``, in order, fill ``shards`` at most."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_shards(ends, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def greedy_shards(ends: list[int], capacity: int, start: int = 0) -> int:
    """Shards that greedy filling needs from group ``start`` on; ``ends`` are running sums."""
    used, at = 0, start
    while at < len(ends):
        at = bisect_right(ends, (ends[at - 1] if at else 0) + capacity, at)
        used += 1
    return used


def cuts(sizes: list[int], shards: int) -> list[int]:
    """First group of the shards after the first (at most ``shards`` - 1).

    No shard exceeds the smallest capacity.  Within it a cut is put where the
    shard comes closest to the mean of what is left, if the rest still fits:
    greedy filling alone would starve the last shards."""
    ends = list(accumulate(sizes))
    capacity, at, out = smallest_capacity(sizes, shards), 0, []
    for left in range(shards, 1, -1):
        if at >= len(ends):
            break
        before = ends[at - 1] if at else 0
        last = bisect_right(ends, before + capacity, at)
        goal = before + (ends[-1] - before) / left
        near = bisect_right(ends, goal, at)
        near += near < len(ends) and abs(ends[near] - goal) < abs((ends[near - 1] if near else 0) - goal)
        # Feasible cuts reach from some least one to ``last``: search it.
        low, high = max(at + 1, min(near, last)), last
        while low < high:
            middle = (low + high) // 2
            if greedy_shards(ends, capacity, middle) <= left - 1:
                high = middle
            else:
                low = middle + 1
        at = low
        if at < len(ends):
            out.append(at)
    return out


def cell_of(text: Column, bits: int = CELL_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits).cast("int")


def minimax_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", bits: int = CELL_BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (by cell order of shards,
    then by key and checksum inside a shard)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = key_and_text(docs, key, text).select(
        "doc_id", (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), cell_of(body, bits).alias("cell"))
    table = sorted((r.cell, r.bytes) for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes")).collect())
    firsts = [table[k][0] for k in cuts([b for _, b in table], shards)]
    shard = sum((F.when(F.col("cell") >= c, 1).otherwise(0) for c in firsts), F.lit(0))
    ready = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.lit(1).cast("long").alias("one"))
    return (grouped_prefix_sums(ready, ["shard"], ["doc_id", "text_crc32", "size"], ["one"], suffix="_before",
                                scratch=scratch_path(docs.sparkSession, "slots"), native=True)
            .select("doc_id", "size", "text_crc32", "shard", F.col("one_before").cast("long").alias("slot")))
