"""Registered order queries (ops 9-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import catalog as C
from larder.operators import orders as O
from larder.plans import bindings as b
from larder.plans.registry import _t, money_out, register


def recipe_dim(t: b.Tables, max_bytes: int | None = None) -> DataFrame:
    lines = b.recipe_lines(t)
    return O.broadcast_recipe_dimension(O.recipe_dimension(b.recipes(t), lines, b.ingredients(t)), lines, max_bytes)


def priced_orders(t: b.Tables) -> DataFrame:
    valid, _ = O.validate_orders(b.requests(t), b.sizes(t), recipe_dim(t))
    return O.price_orders(valid)


@register("validate_orders")
def q_validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request once: valid ones with a NULL reason, rejected with theirs."""
    t = _t(spark, sf_dir)
    return O.check_orders(b.requests(t), b.sizes(t), recipe_dim(t)).select("request_id", "reject_reason")


@register("price_orders")
def q_price_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(priced_orders(t).select("order_id", "recipe_id", "subtotal_cost", "price_adjust",
                                             "selling_price", "profit", "needs_price_confirmation"))


@register("order_lines")
def q_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    lines = O.order_lines(priced_orders(t))
    return money_out(lines.select("order_id", "ingredient_id", "ingredient_name_snapshot", "is_included",
                                  "quantity_snapshot", "unit_price_snapshot", "cost_snapshot",
                                  "price_delta_applied", "is_allergen"))


@register("number_orders")
def q_number_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    valid, _ = O.validate_orders(b.requests(t), b.sizes(t), recipe_dim(t))
    return O.number_orders(valid.select("request_id", "created_at")).select(
        F.col("request_id").alias("order_id"), "order_number")


@register("preview_mismatches")
def q_preview_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    menu = C.recipe_menu(b.recipes(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t))
    return money_out(O.preview_mismatches(priced_orders(t), menu))


def _placed(t: b.Tables):
    from larder.operators.placement import create_orders
    cust = b.customers(t).withColumn("address", F.lit(None).cast("string"))
    return create_orders(b.noted_requests(t), b.sizes(t), recipe_dim(t), cust)


@register("create_orders")
def q_create_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole placement of every request: the orders as stored."""
    placed = _placed(_t(spark, sf_dir))
    return money_out(placed.orders.select(
        "order_id", "order_number", "customer_id", "status", "subtotal_cost", "selling_price", "profit",
        "needs_price_confirmation", "customer_notes", "pickup_date", "pickup_time"))


@register("create_orders_customers")
def q_create_orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole placement of every request: the customer table after it."""
    placed = _placed(_t(spark, sf_dir))
    return money_out(placed.customers.select("id", "name", "phone", "address", "total_orders", "total_spent",
                                             "last_order_at"))


@register("order_confirmation")
def q_order_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmation of every placed order."""
    return money_out(_placed(_t(spark, sf_dir)).confirmation)


@register("stored_orders")
def q_stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placed order in the shape of the stored table."""
    return money_out(_placed(_t(spark, sf_dir)).stored)


def ticked_requests(t: b.Tables) -> DataFrame:
    """The requests with what was ticked in place of id arrays: their order's parts, by return flag, and two lines
    of the recipe. Some have no map, a NULL tick or a recipe that the menu lacks."""
    k = F.col("l_orderkey")
    parts = t.lineitem.groupBy("l_orderkey", "l_partkey").agg((F.max("l_returnflag") == "R").alias("on"))
    first = parts.groupBy("l_orderkey").agg(F.floor(F.min("l_partkey") / 8).cast("long").alias("recipe_id"),
                                            F.collect_list(F.struct("l_partkey", "on")).alias("bought"))
    own = F.array(*[F.struct((F.col("recipe_id") * 8 + (k + n) % 8).alias("l_partkey"), (F.when(k % 6 != n, k % 2 == n % 2)).alias("on"))
                    for n in (0, 3)])
    ids = F.transform("own", lambda x: x["l_partkey"])
    every = F.concat("own", F.filter("bought", lambda x: ~F.array_contains(ids, x["l_partkey"])))
    return first.withColumn("own", own).select(
        k.alias("request_id"), "recipe_id", F.when(k % 11 != 0, F.map_from_entries(every)).alias("ticked"))


@register("selection_arrays")
def q_selection_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's ticks as excluded and extra ids, and the price shown for them."""
    t = _t(spark, sf_dir)
    menu = C.recipe_menu(b.recipes(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t))
    told = O.price_preview(O.selection_arrays(ticked_requests(t), menu), menu)
    return money_out(told.select("request_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in
                                                 ("excluded_ids", "extra_ids")], "preview_price"))


@register("form_checks")
def q_form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with the form's rule and the server's: some have no pickup time."""
    t = _t(spark, sf_dir)
    return O.check_orders(b.requests(t), b.sizes(t), recipe_dim(t), form=True).select("request_id", "reject_reason")
