"""Ops 30, 31 and 33 from daily rollups: partial sums that are kept per day and merged when read.

A rollup has one row per report day, product type, size and status, so a report
over any days reads days x catalog rows however many orders there are. It is
written in numbered versions: after a load, or when orders of some days change,
a version with only those days is added, and of each day the last version
counts. From time to time, write what `read_rollup` gives to a new folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.days import in_days
from larder.operators.reports import _d, _not_cancelled, ranking_of
from larder.schemas import CANCELLED

MEASURES = ("order_count", "sales", "profit")
KEYS = ("created_date", "product_type_id", "size_id", "status")


def report_day(orders: DataFrame, report_tz: str | None = None) -> Column:
    """The report day of `created_at`; a TIMESTAMP_NTZ, or no zone, is taken as it reads."""
    c = F.col("created_at")
    if report_tz is None or not isinstance(orders.schema["created_at"].dataType, T.TimestampType):
        return F.to_date(c)
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(report_tz), c.cast("timestamp_ntz")))


def daily_rollup(orders: DataFrame, report_tz: str | None = None) -> DataFrame:
    """Order count, sales and profit (NULL = 0) per report day, type, size and status; NULLs are values of their own."""
    money = [F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(12,2)")).cast("decimal(28,2)").alias(n)
             for c, n in (("selling_price", "sales"), ("profit", "profit"))]
    return (orders.withColumn("created_date", report_day(orders, report_tz)).groupBy(*KEYS)
            .agg(F.count(F.lit(1)).alias("order_count"), *money))


def write_rollup(rollup: DataFrame, path: str, version: int) -> None:
    """Replace the days that `rollup` has, and no others. A version written again takes its own place."""
    rollup.hint("rebalance").write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def refresh_rollup(orders: DataFrame, path: str, version: int, days: Iterable[str | dt.date], report_tz: str | None = None) -> None:
    """Compute some days again from the orders, of which only those days are read, as a version of their own.

    A day that has no orders any more is left with a row of zeros.
    """
    days = sorted({_d(d) for d in days})
    if not days:
        return
    mine = in_days(orders, "created_at", days[0], days[-1], report_tz) & report_day(orders, report_tz).isin(days)
    fresh = daily_rollup(orders.filter(mine), report_tz)
    kinds = {f.name: f.dataType for f in fresh.schema.fields}
    zero = [F.lit(0 if n in MEASURES else None).cast(kinds[n]).alias(n) for n in fresh.columns if n != "created_date"]
    calendar = orders.sparkSession.createDataFrame([(d,) for d in days], "created_date date")
    write_rollup(fresh.unionByName(calendar.select("created_date", *zero)), path, version)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup as it stands: of each day the last version, without the rows of zeros."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(F.col("created_date").alias("_day")).agg(F.max("version").alias("_last"))  # a row for each day
    newest = F.col("created_date").eqNullSafe(F.col("_day")) & (F.col("version") == F.col("_last"))
    return rows.join(last, newest, "left_semi").where("order_count > 0").drop("version")


def _live(rollup: DataFrame, d1: dt.date, d2: dt.date, cancelled: str) -> DataFrame:
    return rollup.filter(F.col("created_date").between(F.lit(d1), F.lit(d2)) & _not_cancelled(cancelled))


def _sum(c: str, cond: Column | None = None) -> Column:
    return F.coalesce(F.sum(c if cond is None else F.when(cond, F.col(c))), F.lit(0))


def sales_between(rollup: DataFrame, d1: str | dt.date, d2: str | dt.date, cancelled: str = CANCELLED) -> DataFrame:
    """Op 30 from the rollup."""
    return _live(rollup, _d(d1), _d(d2), cancelled).agg(*[_sum(c).alias(c) for c in MEASURES])


def trailing_sales(rollup: DataFrame, day: str | dt.date, cancelled: str = CANCELLED,
                   spans: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Op 31 from the rollup."""
    d = _d(day)
    since = {k: d - dt.timedelta(days=k - 1) for k in spans}
    names = {"order_count": "orders", "sales": "sales", "profit": "profit"}
    return _live(rollup, since[max(spans)], d, cancelled).agg(
        *[_sum(c, F.col("created_date") >= F.lit(since[k])).alias(f"{n}_{k}d") for k in spans for c, n in names.items()])


def sales_ranking(rollup: DataFrame, types: DataFrame, sizes: DataFrame, d1: str | dt.date, d2: str | dt.date,
                  cancelled: str = CANCELLED) -> DataFrame:
    """Op 33 from the rollup."""
    return ranking_of(_live(rollup, _d(d1), _d(d2), cancelled), types, sizes, F.sum("order_count"))
