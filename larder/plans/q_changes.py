"""Registered change-table queries (ops 34-35)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.money import to_money
from larder.functions.numbers import edited_money, edited_number
from larder.operators import changes as CH
from larder.operators import customers as CU
from larder.operators import deletes as DE
from larder.plans import bindings as b
from larder.plans.registry import _t, money_out, register


def change_feed(events: DataFrame) -> DataFrame:
    """Events as a change table: error = delete, signup = insert, others update.

    name is given by every change; value by purchases and clicks; props by
    every third event (an explicit NULL on every sixth)."""
    et = F.col("event_type")
    return events.select(
        F.col("user_id"), F.col("event_id").alias("seq"), F.col("ts").alias("changed_at"),
        F.when(et == "error", "delete").when(et == "signup", "insert").otherwise("update").alias("op"),
        et.alias("name"), F.lit(True).alias("name__set"),
        F.col("value"), et.isin("purchase", "click").alias("value__set"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(F.col("props")).alias("props"),
        (F.col("event_id") % 3 == 0).alias("props__set"))


@register("apply_changes")
def q_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                             F.col("c_acctbal").alias("value"), F.lit(None).cast("string").alias("props"),
                             F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return CH.apply_changes(base, change_feed(t.events), "user_id", ["name", "value", "props"])


@register("new_line_defaults")
def q_new_line_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 34's editor defaults: every part added to the recipe after its own, some with a delta of their own."""
    t = _t(spark, sf_dir)
    p = t.part
    added = p.select((F.floor(F.col("p_partkey") / 8) + 1).cast("long").alias("recipe_id"),
                     F.col("p_partkey").alias("ingredient_id"), F.col("p_partkey").alias("seq"),
                     F.when(F.col("p_size") % 4 == 0, to_money("p_size")).alias("price_delta"))
    return money_out(CH.new_line_defaults(b.recipe_lines(t), added).select(
        "recipe_id", "ingredient_id", "is_customer_optional", "pricing_rule", "price_delta", "is_addon", "display_order"))


@register("cascade_delete")
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting the 'P' orders cascades to their lines."""
    t = _t(spark, sf_dir)
    dead = t.orders.filter(F.col("o_orderstatus") == "P").select("o_orderkey")
    return CH.cascade_delete(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), dead, "l_orderkey")


@register("restrict_check")
def q_restrict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting the inactive ingredients is blocked by the order lines using them."""
    t = _t(spark, sf_dir)
    dead = b.ingredients(t).filter(~F.col("is_active")).select("id")
    return CH.restrict_check(t.lineitem.select("l_partkey"), dead, "l_partkey")


def _deletion(t: b.Tables) -> DE.Deletion:
    """The 'P' orders, every fifth customer, third recipe, second size, inactive ingredients, all types, and keys that aren't there."""
    tables = {"product_types": b.product_types(t), "sizes": b.sizes(t), "ingredients": b.ingredients(t), "recipes": b.recipes(t),
              "recipe_lines": b.recipe_lines(t), "customers": b.customers(t), "orders": b.orders(t).drop("size_id"),
              "order_lines": b.order_lines(t)}
    asked = [("orders", tables["orders"].where(F.col("status") == b.CANCELLED)), ("customers", tables["customers"].where("id % 5 = 0")),
             ("recipes", tables["recipes"].where("id % 3 = 0")), ("sizes", tables["sizes"].where("id % 2 = 0")),
             ("ingredients", tables["ingredients"].where("not is_active")), ("product_types", tables["product_types"]),
             ("customers", tables["customers"].where("id % 50 = 0").select((-F.col("id") - 1).alias("id")))]
    keys = [rows.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id")) for name, rows in asked]
    return DE.delete_closure(tables, reduce(DataFrame.unionByName, keys))


@register("delete_closure")
def q_delete_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes across the whole key graph: what became of each key asked for."""
    return _deletion(_t(spark, sf_dir)).outcome


@register("delete_closure_left")
def q_delete_closure_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that the deletes leave, and the customers' totals corrected for the orders that went."""
    t = _t(spark, sf_dir)
    left = _deletion(t).tables
    counts = [rows.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("table_name"), "n_left",
              F.lit(None).cast("double").alias("total_spent")) for name, rows in left.items() if name != "customers"]
    facts = b.orders(t)
    totals = CU.customer_totals(left["customers"], facts)
    after = DE.correct_customers(totals, facts.join(left["orders"].select("id"), "id", "left_anti"))
    per = after.agg(F.count(F.lit(1)).alias("n_left"), F.sum("total_spent").cast("double").alias("total_spent"))
    counts.append(per.select(F.lit("customers").alias("table_name"), "n_left", "total_spent"))
    return reduce(DataFrame.unionByName, counts)


@register("edited_numbers")
def q_edited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with a price as an admin may type it, read as the editing pages read it."""
    p = _t(spark, sf_dir).part
    size = F.col("p_size").cast("string")
    typed = [F.lit(""), F.lit(None).cast("string"), F.concat(F.lit(" \u00a0\t"), size, F.lit("\u3000\n")),
             F.concat(size, F.lit("."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")), F.concat(size, F.lit("e2")),
             F.lit(".5"), F.concat(size, F.lit(".")), F.concat(F.lit("0x"), F.hex("p_partkey")), F.lit("0b101"), F.lit("0O17"),
             F.lit("Infinity"), F.lit("-Infinity"), F.concat(size, F.lit(",5")), F.concat(F.lit("-"), size, F.lit("E+1")), F.lit("1e400"),
             F.col("p_name")]
    text = F.get(F.array(*typed), (F.col("p_partkey") % len(typed)).cast("int"))
    rows = p.select("p_partkey", text.alias("typed"))
    n = edited_number("typed")
    infinite = F.abs(n) == float("inf")
    return money_out(rows.select("p_partkey", F.when(~infinite, n).alias("value"), infinite.alias("is_infinite"),
                                 edited_money("typed").alias("money")))
