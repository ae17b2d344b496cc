"""Time helpers as built-in Column expressions (whole-stage codegen, no UDF).

All conversions stay in ``timestamp_ntz`` so that the session time zone never
changes a result: an epoch value becomes a UTC wall-clock timestamp, which
``convert_timezone`` moves to the local wall clock before taking the date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def ntz_from_micros(us) -> Column:
    """Microseconds since 1970 -> UTC wall-clock ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", _c(us), _epoch_ntz())


def micros_of(ts_ntz) -> Column:
    """UTC wall-clock ``timestamp_ntz`` -> microseconds since 1970 (bigint)."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), _c(ts_ntz))


def local_day_us(us, tz: str = "America/Los_Angeles") -> Column:
    """Calendar day in ``tz`` of an epoch-microsecond instant."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ntz_from_micros(us)))


def local_day_ms(ms, tz: str = "America/Los_Angeles") -> Column:
    """Calendar day in ``tz`` of an epoch-millisecond instant."""
    return local_day_us(_c(ms) * F.lit(1000), tz)


def utc_day_us(us) -> Column:
    """UTC calendar day of an epoch-microsecond instant."""
    return F.to_date(ntz_from_micros(us))


def day_int(d) -> Column:
    """DATE -> yyyymmdd as bigint."""
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("bigint")


def day_from_int(x) -> Column:
    """yyyymmdd (int, bigint or digit string) -> DATE."""
    v = _c(x).cast("bigint")
    return F.make_date(
        F.floor(v / 10000).cast("int"),
        F.floor(v / 100).cast("int") % 100,
        (v % 100).cast("int"),
    )


def date_id(d, epoch: date) -> Column:
    """DATE -> integer day number counted from ``epoch``."""
    return F.datediff(_c(d), F.lit(epoch)).cast("int")


def date_of_id(i, epoch: date) -> Column:
    return F.date_add(F.lit(epoch), _c(i).cast("int"))


def period_year(i, epoch: date) -> Column:
    return F.year(date_of_id(i, epoch))


def period_quarter(i, epoch: date) -> Column:
    return F.quarter(date_of_id(i, epoch)).cast("int")


def day_epoch_ms(d, hours: int = 8) -> Column:
    """Epoch milliseconds of ``d`` 00:00 UTC plus a fixed ``hours`` offset (no DST)."""
    return F.unix_date(_c(d)).cast("bigint") * F.lit(86_400_000) + F.lit(hours * 3_600_000)


def month_name(d) -> Column:
    return F.date_format(_c(d), "MMMM")
