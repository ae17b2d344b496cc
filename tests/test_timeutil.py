"""Local-day rules, including DST change days and a non-UTC session zone."""

from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from daybook.functions import timeutil as tu


def us(y, mo, d, h=0, mi=0):
    return int(datetime(y, mo, d, h, mi, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    # (epoch us, expected Los Angeles day)
    (us(2024, 1, 2, 7, 59), date(2024, 1, 1)),  # PST: local midnight is 08:00 UTC
    (us(2024, 1, 2, 8, 0), date(2024, 1, 2)),
    (us(2024, 3, 10, 7, 59), date(2024, 3, 9)),  # DST starts 2024-03-10 02:00 local
    (us(2024, 3, 10, 8, 0), date(2024, 3, 10)),
    (us(2024, 3, 11, 6, 59), date(2024, 3, 10)),  # PDT: local midnight is 07:00 UTC
    (us(2024, 3, 11, 7, 0), date(2024, 3, 11)),
    (us(2024, 11, 3, 6, 59), date(2024, 11, 2)),  # DST ends 2024-11-03
    (us(2024, 11, 4, 7, 59), date(2024, 11, 3)),
    (us(2024, 11, 4, 8, 0), date(2024, 11, 4)),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_local_day_independent_of_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(u,) for u, _ in CASES], "us bigint")
        got = [
            r[0]
            for r in df.select(tu.local_day_us("us")).collect()
        ]
        ms_got = [r[0] for r in df.select(tu.local_day_ms(F.expr("us div 1000"))).collect()]
        assert got == [d for _, d in CASES]
        assert ms_got == got
        utc = [r[0] for r in df.select(tu.utc_day_us("us")).collect()]
        assert utc == [datetime.fromtimestamp(u / 1e6, tz=timezone.utc).date() for u, _ in CASES]
        back = [r[0] for r in df.select(tu.micros_of(tu.ntz_from_micros("us"))).collect()]
        assert back == [u for u, _ in CASES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_day_int_round_trip(spark):
    df = spark.createDataFrame([(20240130,), (20161111,), (19991231,)], "d bigint")
    out = df.select(tu.day_from_int("d").alias("x")).select(tu.day_int("x")).collect()
    assert [r[0] for r in out] == [20240130, 20161111, 19991231]


def test_date_id_period_helpers(spark):
    epoch = date(1995, 1, 1)
    df = spark.createDataFrame([(0,), (2403,), (2190,)], "i int")
    r = df.select(tu.period_year("i", epoch), tu.period_quarter("i", epoch), tu.date_of_id("i", epoch)).collect()
    assert [tuple(x) for x in r] == [
        (1995, 1, date(1995, 1, 1)),
        (2001, 3, date(2001, 7, 31)),
        (2000, 4, date(2000, 12, 30)),
    ]


def test_day_epoch_and_month(spark):
    df = spark.createDataFrame([(date(2024, 1, 31),), (date(2024, 7, 4),)], "d date")
    r = df.select(tu.day_epoch_ms("d", 8), tu.month_name("d")).collect()
    assert [tuple(x) for x in r] == [(1706659200000 + 8 * 3600000, "January"), (1720051200000 + 8 * 3600000, "July")]
