"""Exact deduplication with a heavy-hitter split.

1. Digests (SHA-256 of the text) are written once as a small table.
2. Misra-Gries: every task keeps at most ``counters`` digests and decrements all
   when a new one finds no room.  A digest with more than 1/(counters + 1) of
   a task's rows survives there; the summaries of all tasks are added up by
   an ordinary aggregate, and the ``counters`` largest sums are candidates.
3. Candidates are verified by counting them exactly over the whole table, with
   the row that stays.  The winners, at most ``counters`` rows, are broadcast:
   their rows are decided map-side and never shuffled.
4. All other digests take an ordinary aggregate and join.

Missing a candidate costs speed only, as step 4 treats what step 3 leaves.

Defined cases: a null text is the empty text; of equal texts the largest doc_id
stays (nulls count as smallest); of rows repeating doc_id and text too, the
per-row result marks each as kept, and ``deduplicated`` returns one of them; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_and_text, lean, one_of_repeats, rewritten

#: Frequent digests looked for: bounds a task's summary and the broadcast (1024 x 48 bytes).
COUNTERS = 1024


def misra_gries(counts: dict[bytes, int], values: dict[bytes, int], room: int) -> dict[bytes, int]:
    """Add counted ``values`` to the summary ``counts``, which keeps ``room`` entries."""
    for v, n in values.items():
        counts[v] = counts.get(v, 0) + n
    if len(counts) > room:
        # Taking off the (room + 1)-th count leaves ``room`` at most: many decrements at once.
        off = sorted(counts.values(), reverse=True)[room]
        counts = {v: n - off for v, n in counts.items() if n > off}
    return counts


def _summaries(room: int):
    def run(batches):
        counts: dict[bytes, int] = {}
        for b in batches:
            got = b.column(0).value_counts()
            counts = misra_gries(counts, dict(zip(got.field(0).to_pylist(), got.field(1).to_pylist(), strict=True)), room)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "low"])

    return run


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return key_and_text(docs, key, text).select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"))


def frequent(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, keep_id, n, n_same) of at most ``counters`` frequent digests."""
    summary = table.select("digest").mapInArrow(lean(_summaries(counters)), "digest binary, low long")
    ahead = (summary.groupBy("digest").agg(F.sum("low").alias("low")).where("low > 1")
             .orderBy(F.desc("low"), "digest").limit(counters).select("digest"))
    return _decided(table.join(F.broadcast(ahead), "digest", "left_semi"))


def _decided(table: DataFrame) -> DataFrame:
    each = table.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return each


def groups(table: DataFrame, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(frequent winners, all other groups): digest, keep_id, group_size."""
    winners = rewritten(frequent(table, counters), "winners")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return winners, _decided(rest)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    table = rewritten(digests(docs, key, text), "digests")
    winners, others = groups(table, counters)
    hot = table.join(F.broadcast(winners), "digest")
    cold = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti").join(others, "digest")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns."""
    table = rewritten(digests(docs, key, text), "digests")
    winners, others = groups(table, counters)
    others = rewritten(others, "groups")
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(body, 256)).alias("digest"), docs[key].cast("long").alias("doc_id"))
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").join(others, "digest")
    stay = hot.unionByName(cold).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows that repeat doc_id and text: only where such rows exist at all.
    again = rewritten(table.groupBy("doc_id", "digest").count().where("count > 1"), "repeats").select("doc_id", "digest")
    out = stay.select("row.*")
    if again.isEmpty():
        return out
    marked = stay.join(again.select(F.col("doc_id").alias("d2"), F.col("digest").alias("g2")),
                       F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("digest") == F.col("g2")), "left")
    return one_of_repeats(marked.select("row", F.col("g2").isNotNull().alias("again"), "digest"),
                          F.col("again"), [F.col("digest")]).select("row.*")
