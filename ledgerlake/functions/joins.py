"""Join shapes that stay balanced when one key is very hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_hot_right(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``left LEFT JOIN right USING key`` for a ``left`` with unique keys and
    a ``right`` side where one key may hold a large share of all rows.

    AQE can split a skewed partition only on a side whose rows may be
    duplicated safely; for a left outer join that is the left side, so a hot
    key on the right would stay in one task.  Instead: the inner join (either
    side splittable) plus the left rows without any partner, found by an
    anti-join against the *distinct* right keys (the distinct aggregate
    collapses a hot key to one row map-side)."""
    matched = left.join(right, key, "inner")
    right_keys = right.select(*key).distinct()
    extra = [c for c in right.columns if c not in key]
    unmatched = left.join(right_keys, key, "left_anti").select(
        *left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra])
    return matched.unionByName(unmatched)
