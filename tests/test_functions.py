"""Scalar helpers and the named-query catalogue."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from ledgerlake.functions import display as disp
from ledgerlake.functions.timefns import ceil_to_hour, trunc_ntz
from ledgerlake.plans.catalogue import CATALOGUE, run_query

from conftest import SF_SMALL


def test_display_formats(spark):
    df = spark.createDataFrame(
        [(Decimal("1234.50"), dt.datetime(2024, 1, 3, 15, 4), "Customer#000000001"),
         (Decimal("-5.00"), dt.datetime(2024, 12, 25), "Short")],
        "amt decimal(14,2), ts timestamp_ntz, name string")
    got = df.select(disp.format_currency(F.col("amt")).alias("c"), disp.format_date(F.col("ts")).alias("d"),
                    disp.truncate(F.col("name"), 12).alias("t"), disp.capitalize(F.lit("issued")).alias("l"),
                    disp.format_number(F.lit(1234567)).alias("n")).collect()
    assert [tuple(r) for r in got] == [("$1,234.50", "Jan 3, 2024", "Customer#000...", "Issued", "1,234,567"),
                                       ("-$5.00", "Dec 25, 2024", "Short", "Issued", "1,234,567")]


def test_bands_edges(spark):
    df = spark.range(0, 100).select(F.col("id").cast("int").alias("x"))
    got = {r.x: (r.s, r.d, r.a) for r in df.select(
        "x", disp.band_below(F.col("x"), disp.STOCK_BANDS, "green").alias("s"),
        disp.band_at_least(F.col("x"), disp.DAYS_BANDS, "red").alias("d"),
        disp.band_at_least(F.col("x") * 1000, disp.AR_AMOUNT_BANDS, "green").alias("a")).collect()}
    assert got[9] == ("red", "red", "green") and got[10] == ("yellow", "red", "yellow")
    assert got[19][0] == "yellow" and got[20][0] == "green"
    assert got[29][1] == "red" and got[30][1] == "yellow" and got[60][1] == "orange" and got[90][1] == "dark-red"
    assert got[49][2] == "yellow" and got[50][2] == "red"


def test_ceil_to_hour_matches_truncated_comparison(spark):
    """``date_trunc('hour', ts) >= t``  <=>  ``ts >= ceil_to_hour(t)``."""
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m, s),) for h in (9, 10, 11) for m in (0, 29, 59)
                                for s in (0, 30)], "ts timestamp_ntz")
    for cutoff in ("2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 09:59:59.5"):
        c = F.lit(cutoff).cast("timestamp_ntz")
        a = ts.filter(trunc_ntz("hour", F.col("ts")) >= c).count()
        b = ts.filter(F.col("ts") >= ceil_to_hour(c)).count()
        assert a == b


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_catalogue_equals_registered_query(spark, name):
    named = run_query(spark, SF_SMALL, name, limit=100)
    registered = se.queries()[name](spark, SF_SMALL)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, registered.collect()))
