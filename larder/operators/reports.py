"""Ops 26-28, 30-33: needs, selection statistics, sales indicators, rankings.

All reduction runs on executors with partial (map-side) aggregation, so a hot
ingredient or day never lands whole on one task; only the few result rows
reach the caller. Date bounds are literals on raw columns (pushed to Parquet).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.days import day_start, in_days
from larder.schemas import CANCELLED, MISSING_NAME


def _d(x: str | dt.date) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def ingredient_needs(lines: DataFrame, orders: DataFrame, ingredients: DataFrame, d1: str | dt.date,
                     d2: str | dt.date, cancelled: str = CANCELLED) -> DataFrame:
    """Op 26: included quantity by (ingredient, snapshot name, current unit) for
    non-cancelled orders picked up in [d1, d2]; largest first.

    The unit join comes after aggregation, on one row per (ingredient, name).
    """
    o = orders.filter((F.col("status") != cancelled)
                      & F.col("pickup_date").between(F.lit(_d(d1)), F.lit(_d(d2)))).select(
        F.col("id").alias("order_id"))
    per = (lines.filter(F.col("is_included"))
           .select("order_id", "ingredient_id", "ingredient_name_snapshot", "quantity_snapshot")
           .join(o, "order_id")
           .groupBy("ingredient_id", "ingredient_name_snapshot")
           .agg(F.sum("quantity_snapshot").alias("total_quantity")))
    unit = ingredients.select(F.col("id").alias("ingredient_id"), "unit")
    return (per.join(unit, "ingredient_id")
               .select("ingredient_id", F.col("ingredient_name_snapshot").alias("ingredient_name"), "unit",
                       "total_quantity")
               .orderBy(F.col("total_quantity").desc(), "ingredient_id", "ingredient_name"))


def selection_stats(lines: DataFrame, orders: DataFrame, d1: str | dt.date, d2: str | dt.date,
                    report_tz: str | None = None) -> DataFrame:
    """Op 27: included / left-out line counts by snapshot name, for orders
    created in [d1, d2]. Cancelled orders count; an add-on not taken counts as
    left out. Lines that carry their order's `created_at` (op 11 gives it) are
    bounded by it too, which prunes the folders of `write_order_lines`."""
    if "created_at" in lines.columns:
        lines = lines.filter(in_days(lines, "created_at", d1, d2, report_tz))
    o = orders.filter(in_days(orders, "created_at", d1, d2, report_tz)).select(F.col("id").alias("order_id"))
    return (lines.join(o, "order_id", "left_semi")
            .groupBy(F.col("ingredient_name_snapshot").alias("ingredient_name"))
            .agg(F.count_if(F.col("is_included")).alias("included_count"),
                 F.count_if(~F.col("is_included")).alias("excluded_count")))


def _first(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def top_selected(stats: DataFrame, n: int | None = None) -> DataFrame:
    """Op 28: most included first (ties by name); the top n if the caller states it."""
    return (_first(stats.filter(F.col("included_count") > 0)
                   .orderBy(F.col("included_count").desc(), "ingredient_name"), n)
            .select("ingredient_name", F.col("included_count").alias("count")))


def top_excluded(stats: DataFrame, n: int | None = None) -> DataFrame:
    """Op 28: most left out first, ties by included count, then name; the top n if stated."""
    return (_first(stats.filter(F.col("excluded_count") > 0)
                   .orderBy(F.col("excluded_count").desc(), F.col("included_count").desc(), "ingredient_name"), n)
            .select("ingredient_name", F.col("excluded_count").alias("count")))


def _not_cancelled(cancelled: str):
    # The browser filter `status !== cancelled` keeps a NULL status.
    return ~F.col("status").eqNullSafe(F.lit(cancelled))


def _money_sum(c: str, cond=None):
    v = F.coalesce(F.col(c), F.lit(0))
    # The sum keeps its own, wider decimal: a total outgrows the column's 12 digits.
    return F.coalesce(F.sum(v if cond is None else F.when(cond, v)), F.lit(0))


def sales_between(orders: DataFrame, d1: str | dt.date, d2: str | dt.date, cancelled: str = CANCELLED,
                  report_tz: str | None = None) -> DataFrame:
    """Op 30: count, sales and profit of non-cancelled orders created in [d1, d2]."""
    live = orders.filter(in_days(orders, "created_at", d1, d2, report_tz) & _not_cancelled(cancelled))
    return live.agg(F.count(F.lit(1)).alias("order_count"), _money_sum("selling_price").alias("sales"),
                    _money_sum("profit").alias("profit"))


def trailing_sales(orders: DataFrame, day: str | dt.date, cancelled: str = CANCELLED,
                   report_tz: str | None = None, spans: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Op 31: 1-, 7- and 30-day totals ending on `day`, in one pass."""
    d = _d(day)
    widest = d - dt.timedelta(days=max(spans) - 1)
    live = orders.filter(in_days(orders, "created_at", widest, d, report_tz) & _not_cancelled(cancelled))
    aggs = []
    for k in spans:
        since = F.col("created_at") >= day_start(orders, "created_at", d - dt.timedelta(days=k - 1), report_tz)
        aggs += [F.count_if(since).alias(f"orders_{k}d"), _money_sum("selling_price", since).alias(f"sales_{k}d"),
                 _money_sum("profit", since).alias(f"profit_{k}d")]
    return live.agg(*aggs)


def day_kpis(orders: DataFrame, day: str | dt.date, cancelled: str = CANCELLED,
             report_tz: str | None = None) -> DataFrame:
    """Op 32: orders created (cancelled included), pickups (cancelled included),
    and sales, cost, profit of the day's non-cancelled orders, in one pass."""
    d = _d(day)
    created = in_days(orders, "created_at", d, d, report_tz)
    pickup = F.col("pickup_date") == F.lit(d)
    live = created & _not_cancelled(cancelled)
    return orders.filter(created | pickup).agg(
        F.count_if(created).alias("orders_created"), F.count_if(pickup).alias("pickups"),
        _money_sum("selling_price", live).alias("sales"), _money_sum("subtotal_cost", live).alias("cost"),
        _money_sum("profit", live).alias("profit"))


def _shown_name(c: str):
    """A missing or empty name is shown as the placeholder (browser `name || '—'`)."""
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(MISSING_NAME)).otherwise(F.col(c))


def sales_ranking(orders: DataFrame, types: DataFrame, sizes: DataFrame, d1: str | dt.date, d2: str | dt.date,
                  cancelled: str = CANCELLED, report_tz: str | None = None) -> DataFrame:
    """Op 33: order counts by type name and by size name (missing or empty = '—'), plus
    the grand total, in one grouping-sets pass; `grouping_id` tells the sets
    apart even where a name is NULL."""
    live = orders.filter(in_days(orders, "created_at", d1, d2, report_tz) & _not_cancelled(cancelled))
    return ranking_of(live, types, sizes, F.count(F.lit(1)))


def ranking_of(live: DataFrame, types: DataFrame, sizes: DataFrame, count: Column) -> DataFrame:
    """The ranking over rows with product_type_id and size_id, each counting as the aggregate `count` has it."""
    t = types.select(F.col("id").alias("product_type_id"), F.col("name").alias("_tn"))
    s = sizes.select(F.col("id").alias("size_id"), F.col("name").alias("_sn"))
    named = (live.join(t, "product_type_id", "left").join(s, "size_id", "left")
             .withColumn("type_name", _shown_name("_tn")).withColumn("size_name", _shown_name("_sn")))
    g = named.groupingSets([["type_name"], ["size_name"], []], "type_name", "size_name").agg(
        count.alias("order_count"), F.grouping_id().alias("_gid"))
    dim = F.when(F.col("_gid") == 1, "type").when(F.col("_gid") == 2, "size").otherwise("total")
    return (g.select(dim.alias("dimension"),
                     F.when(F.col("_gid") == 1, F.col("type_name")).when(F.col("_gid") == 2, F.col("size_name"))
                     .alias("name"), "order_count")
            .orderBy("dimension", F.col("order_count").desc(), "name"))
