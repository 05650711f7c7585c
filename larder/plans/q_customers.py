"""Registered customer and audit queries (ops 22-25, 29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.money import to_money
from larder.operators import customers as CU
from larder.operators import quality as Q
from larder.plans import bindings as b
from larder.plans.registry import _t, money_out, register


@register("upsert_customers")
def q_upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts from the event log (user = phone, a third of them unknown so far;
    event type = name, props = address on every third event) merged into the customer table."""
    t = _t(spark, sf_dir)
    existing = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_custkey").cast("string").alias("phone"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("addr "), F.col("c_nationkey").cast("string")))
         .alias("address"), F.lit(None).cast(t.events.schema["ts"].dataType).alias("created_at"),
        F.col("c_nationkey").alias("total_orders"), to_money("c_acctbal").alias("total_spent"))
    phone = F.col("user_id") + F.when(F.col("user_id") % 3 == 0, F.lit(10_000_000)).otherwise(F.lit(0))
    contacts = t.events.select(
        phone.cast("string").alias("customer_phone"), F.col("event_type").alias("customer_name"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("customer_address"),
        F.col("event_id").alias("seq"), F.col("ts").alias("created_at"))
    out = CU.upsert_customers(existing, contacts)
    known = existing.select(F.col("id").alias("_known"))
    return money_out(out.join(known, out.id == known._known, "left").select(
        "phone", "name", "address", "created_at", "total_orders", "total_spent", F.col("_known").isNull().alias("is_new")))


@register("customer_totals")
def q_customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    out = CU.customer_totals(b.customers(t), b.orders(t))
    return money_out(out.select("id", "total_orders", "total_spent", "last_order_at"))


def ledger_events(t: b.Tables) -> DataFrame:
    """Orders as an add/delete log: a 'P' order is a delete of its amount. `seq` is as sparse as a clock's microseconds."""
    o = t.orders
    return o.select(F.col("o_custkey").alias("customer_id"), (F.col("o_orderkey") * 1_000_003).alias("seq"),
                    F.when(F.col("o_orderstatus") == "P", "delete").otherwise("add").alias("kind"),
                    F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(to_money("o_totalprice"))
                    .alias("amount"),
                    F.col("o_orderdate").alias("ts"))


@register("customer_ledger")
def q_customer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(CU.customer_ledger(ledger_events(t)))


@register("phone_duplicates")
def q_phone_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 25; every fifth customer has a phone of its own, the others share theirs."""
    t = _t(spark, sf_dir)
    own = F.concat(F.lit("+1"), F.lpad(F.col("id").cast("string"), 10, "0"))
    return CU.phone_duplicates(b.customers(t).withColumn("phone", F.when(F.col("id") % 5 == 0, own).otherwise(F.col("phone"))))


@register("integrity_audit")
def q_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    li, o, p, c = t.lineitem, t.orders, t.part, t.customer
    recipes, sizes = b.recipes(t), b.sizes(t)
    rs = recipes.join(sizes.select(F.col("id").alias("size_id"), "pricing_mode"), "size_id", "left")
    return Q.integrity_audit([
        Q.unique_check(o, ["o_orderkey"], "orders.unique_id"),
        Q.unique_check(p, ["p_partkey"], "part.unique_id"),
        Q.unique_check(li, ["l_orderkey", "l_partkey"], "lineitem.unique_order_part"),
        Q.unique_check(li, ["l_orderkey", "l_linenumber"], "lineitem.unique_order_line"),
        Q.foreign_key_check(li, "l_orderkey", o, "o_orderkey", "lineitem.fk_order"),
        Q.foreign_key_check(li, "l_partkey", p, "p_partkey", "lineitem.fk_part"),
        Q.foreign_key_check(o, "o_custkey", c, "c_custkey", "orders.fk_customer"),
        Q.row_checks(o, {"orders.created_not_null": Q.not_null_rule("o_orderdate"),
                         "orders.status_allowed": Q.allowed_values_rule("o_orderstatus", ["F", "O", "P"])}),
        Q.allowed_values_check(li, "l_returnflag", ["A", "N", "R"], "lineitem.flag_allowed"),
        Q.null_only_when_check(rs, "base_selling_price", F.col("pricing_mode") == "custom",
                               "recipes.price_null_only_custom"),
    ])


@register("kitchen_audit")
def q_kitchen_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data model's rules over the bound tables, with phones as sign-in spells
    them. The bindings break some: shared phones, statuses and sizes of other names."""
    t = _t(spark, sf_dir)
    customers = CU.standardise_phones(b.customers(t)).drop("address", "last_order_at", "phone") \
        .withColumnRenamed("phone_std", "phone")
    return Q.kitchen_audit({
        "product_types": b.product_types(t), "sizes": b.sizes(t), "ingredients": b.ingredients(t),
        "recipes": b.recipes(t), "recipe_lines": b.recipe_lines(t), "customers": customers, "orders": b.orders(t),
        "order_lines": b.order_lines(t)})
