"""Clock arithmetic (F19-F22).  The clock is always a parameter or a column,
never the wall clock inside a transformation, so results are repeatable."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock(ts) -> Column:
    """A timestamp parameter (datetime / ISO text) as a TIMESTAMP_NTZ literal.

    Built from text so no session or Python time zone is applied."""
    if isinstance(ts, Column):
        return ts
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    return F.lit(ts.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def utc_stamp(ts) -> Column:
    """``date -u +%Y%m%d-%H%MUTC``."""
    return F.concat(F.date_format(_c(ts), "yyyyMMdd-HHmm"), F.lit("UTC"))


def utc_day(ts) -> Column:
    """``date -u +%Y-%m-%d``."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def trunc_minute(ts) -> Column:
    return F.date_trunc("minute", _c(ts)).cast("timestamp_ntz")


def lease_start(now) -> Column:
    """now + 1 minute, cut to the minute."""
    return trunc_minute(_c(now) + F.expr("INTERVAL 1 MINUTE"))


def lease_end(now, days: int = 7) -> Column:
    """now + ``days`` days, cut to the minute."""
    return trunc_minute(_c(now) + F.make_dt_interval(F.lit(days)))


def plus_decimal_days(start, days) -> Column:
    """start + a DECIMAL number of days, to the microsecond."""
    d = _c(days).cast("decimal(18,6)")
    return _c(start) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (d * F.lit(86400)).cast("decimal(18,6)"))


def within_days(ts, asof, days: int) -> Column:
    """Age filter: ``ts >= asof - days``."""
    return _c(ts) >= clock(asof) - F.make_dt_interval(F.lit(days))
