"""Registered list queries (ops 14-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import lists as L
from larder.plans import bindings as b
from larder.schemas import ORDER_BOARD_LIMIT, UPCOMING_LIMIT
from larder.plans.registry import _t, money_out, register

# Allergy words in the test documents' languages, and the kitchen's own.
NOTE_PATTERN = "(?i)allerg|alerg|حساس"


def facts(t: b.Tables) -> DataFrame:
    return L.order_facts(b.orders(t), b.customers(t), b.product_types(t), b.order_sizes(t))


def _of_nation(t: b.Tables) -> DataFrame:
    """The customers that the histories are asked for."""
    return t.customer.filter(F.col("c_nationkey") == b.NATION)


@register("order_facts")
def q_order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(facts(t).select("id", "customer_id", "customer_name", "customer_phone", "type_name",
                                     "size_name", "status", "selling_price", "pickup_date", "created_at"))


@register("order_board")
def q_order_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    board = L.order_board(b.orders(t), b.customers(t), b.product_types(t), b.order_sizes(t),
                          limit=ORDER_BOARD_LIMIT)
    return money_out(board.select("id", "created_at", "status", "customer_name", "customer_phone", "type_name",
                                  "size_name", "selling_price", "price_pending", "allergy_note"))


@register("pickups_on")
def q_pickups_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return money_out(L.pickups_on(facts(t), b.TODAY).select(
        "id", "pickup_time", "status", "customer_name", "type_name", "size_name", "selling_price"))


@register("upcoming_orders")
def q_upcoming_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    up = L.upcoming_orders(b.orders(t), b.customers(t), b.product_types(t), b.order_sizes(t), b.TODAY,
                           limit=UPCOMING_LIMIT, cancelled=b.CANCELLED)
    return money_out(up.select("id", "pickup_date", "pickup_time", "status", "customer_name", "customer_phone",
                               "type_name", "size_name", "selling_price"))


@register("customer_list")
def q_customer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.operators.customers import customer_totals
    t = _t(spark, sf_dir)
    out = L.customer_list(customer_totals(b.customers(t), b.orders(t)))
    return money_out(out.select("id", "name", "phone", "total_orders", "total_spent", "last_order_at"))


@register("customer_history")
def q_customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 19 for the customers of one nation."""
    t = _t(spark, sf_dir)
    hist = L.customer_history(facts(t), _of_nation(t).select(F.col("c_custkey").alias("id")))
    return money_out(hist.select("customer_id", "id", "created_at", "status", "selling_price", "type_name",
                                 "size_name"))


@register("order_detail")
def q_order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 20 for the orders of one nation's customers."""
    t = _t(spark, sf_dir)
    asked = t.orders.join(_of_nation(t), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"))
    return money_out(L.order_detail(b.order_lines(t), asked))


@register("flag_allergy_notes")
def q_flag_allergy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes are the documents' texts (whole texts, regex over each)."""
    t = _t(spark, sf_dir)
    notes = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("customer_notes"))
    out = L.flag_allergy_notes(notes, b.order_lines(t), NOTE_PATTERN)
    return out.select("id", "allergy_note", "allergen_line")
