"""Report days.

One meaning of "day" everywhere: the calendar day in `report_tz`, as the
half-open range [d 00:00, d+1 00:00). Bounds are constant-folded literals on the
raw column, so the range is pushed into the Parquet scan (`PushedFilters`)
instead of wrapping the column in `to_date`, which Spark cannot push down.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_date(d: str | dt.date) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def day_start(df: DataFrame, col: str, d: str | dt.date, report_tz: str | None = None) -> Column:
    """The first instant of day `d` in the type of `df[col]`."""
    day = _as_date(d)
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.DateType):
        return F.lit(day)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(dt.datetime(day.year, day.month, day.day))
    if report_tz is None:
        return F.lit(day).cast("timestamp")
    return F.make_timestamp(F.lit(day.year), F.lit(day.month), F.lit(day.day), F.lit(0), F.lit(0),
                            F.lit(0), F.lit(report_tz))


def in_days(df: DataFrame, col: str, d1: str | dt.date, d2: str | dt.date,
            report_tz: str | None = None) -> Column:
    """`col` falls on a day in [d1, d2], both inclusive.

    Facts partitioned by `created_date` are pruned too, to a day more on either
    side, as their zone may be another than the report's.
    """
    day = dt.timedelta(days=1)
    first, end = _as_date(d1), _as_date(d2) + day
    inside = (F.col(col) >= day_start(df, col, first, report_tz)) & (F.col(col) < day_start(df, col, end, report_tz))
    if col == "created_at" and "created_date" in df.columns:
        inside &= F.col("created_date").between(F.lit(first - day), F.lit(end))
    return inside
