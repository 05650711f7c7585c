"""Registered report queries (ops 26-28, 30-33)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import reports as R
from larder.operators import rollups as RU
from larder.plans import bindings as b
from larder.schemas import RANKING_LIMIT
from larder.plans.registry import _t, money_out, register
from larder.session import scratch_path

# Report ranges over the test data (orders span 1995-01 .. 2001-08).
STATS_FROM = "1996-01-01"
ALL_FROM, ALL_TO = "1992-01-01", "2010-12-31"


def stats(t: b.Tables) -> DataFrame:
    return R.selection_stats(b.order_lines(t), b.orders(t), STATS_FROM, b.TODAY)


@register("ingredient_needs")
def q_ingredient_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(R.ingredient_needs(b.order_lines(t), b.orders(t), b.ingredients(t), b.TODAY, b.WEEK_END,
                                        cancelled=b.CANCELLED))


@register("selection_stats")
def q_selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(_t(spark, sf_dir))


@register("top_selected")
def q_top_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_selected(stats(_t(spark, sf_dir)), n=RANKING_LIMIT)


@register("top_excluded")
def q_top_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_excluded(stats(_t(spark, sf_dir)), n=RANKING_LIMIT)


@register("sales_between")
def q_sales_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(R.sales_between(b.orders(t), ALL_FROM, ALL_TO, cancelled=b.CANCELLED))


@register("trailing_sales")
def q_trailing_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(R.trailing_sales(b.orders(t), b.TODAY, cancelled=b.CANCELLED))


@register("day_kpis")
def q_day_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(R.day_kpis(b.orders(t), b.TODAY, cancelled=b.CANCELLED))


@register("sales_ranking")
def q_sales_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return R.sales_ranking(b.orders(t), b.product_types(t), b.order_sizes(t), STATS_FROM, b.TODAY,
                           cancelled=b.CANCELLED)


def _rollup(t: b.Tables) -> DataFrame:
    """The rollup as two loads and a change of status have left it: first the orders as they would stand if every
    third one of some days were cancelled, loaded in two parts of days; then those days again, as they are."""
    orders, path = b.orders(t), scratch_path(t.spark, "rollup")
    wrong = orders.withColumn("status", F.when((F.day("created_at") <= 2) & (F.col("id") % 3 == 0), b.CANCELLED).otherwise(F.col("status")))
    for k, part in enumerate((F.month("created_at") <= 6, F.month("created_at") > 6)):
        RU.write_rollup(RU.daily_rollup(wrong.where(part)), path, k)
    days = orders.where(F.day("created_at") <= 2).select(F.to_date("created_at").alias("d")).distinct().collect()  # calendar days
    RU.refresh_rollup(orders, path, 2, [r["d"] for r in days])
    return RU.read_rollup(t.spark, path)


@register("daily_rollup")
def q_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup's rows after loads and a refresh."""
    return money_out(_rollup(_t(spark, sf_dir)))


@register("rollup_trailing")
def q_rollup_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 31 from the rollup."""
    return money_out(RU.trailing_sales(_rollup(_t(spark, sf_dir)), b.TODAY, cancelled=b.CANCELLED))


@register("rollup_ranking")
def q_rollup_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 33 from the rollup."""
    t = _t(spark, sf_dir)
    return RU.sales_ranking(_rollup(t), b.product_types(t), b.order_sizes(t), STATS_FROM, b.TODAY, cancelled=b.CANCELLED)
