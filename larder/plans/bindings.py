"""Test-data views: the driver's TPC-H-like tables in the kitchen's schemas.

A binding only renames, casts and picks columns (plus the keyed aggregates that
stand in for a column the test tables lack, like an order's pickup day). It
does none of an operator's work. `oracle.py` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.money import to_money, to_qty
from larder.plans.testdata import TESTDATA
from larder.sources.tables import read_table

# Binding parameters (fixed here; `oracle.py` uses the same numbers).
TODAY = "1998-06-15"
WEEK_END = "1998-06-22"
RANGE_START = "1998-05-17"
CANCELLED = "P"
NATION = 7


class Tables:
    """Lazy typed reads of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, schemas=TESTDATA)


def _rid(col: str = "p_partkey") -> Column:
    return F.floor(F.col(col) / 8).cast("long")


def ingredients(t: Tables) -> DataFrame:
    p = t.part
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("unit"),
        to_money("p_retailprice").alias("unit_price"),
        F.when(F.col("p_size") % 5 == 0, "direct").otherwise("quantity").alias("cost_method"),
        to_money(F.col("p_size") * 3).alias("direct_cost"),
        (F.col("p_size") % 11 != 0).alias("is_active"),
        (F.col("p_size") % 13 != 0).alias("is_visible_to_customer"),
        (F.col("p_size") % 2 == 0).alias("is_customer_removable"),
        (F.col("p_size") % 17 == 0).alias("is_core"),
        (F.col("p_size") % 7 == 0).alias("is_allergen"))


def recipe_lines(t: Tables) -> DataFrame:
    p = t.part
    return p.select(
        _rid().alias("recipe_id"), F.col("p_partkey").alias("ingredient_id"),
        to_qty(F.col("p_size") / F.lit(8.0)).alias("quantity"),
        (F.col("p_partkey") % 3 != 0).alias("is_customer_optional"),
        F.when(F.col("p_partkey") % 4 == 0, "extra_cost_addon")
         .when(F.col("p_partkey") % 4 == 1, "included_reduce_on_remove")
         .otherwise("included_fixed").alias("pricing_rule"),
        to_money(F.col("p_size") * 10).alias("price_delta"),
        (F.col("p_partkey") % 5 == 0).alias("is_addon"),
        (F.col("p_partkey") % 8).cast("int").alias("display_order"))


def recipes(t: Tables) -> DataFrame:
    """One recipe per block of 8 parts; type = rid % 5, size = rid (unique pair)."""
    rid = t.part.select(_rid().alias("id")).distinct()
    return rid.select(
        "id", (F.col("id") % 5).alias("product_type_id"), F.col("id").alias("size_id"),
        F.concat(F.lit("recipe "), F.col("id").cast("string")).alias("name"),
        to_money(F.lit(1000)).alias("packaging_cost"), to_money(F.lit(0)).alias("extra_cost"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(to_money(F.col("id") + 20000))
         .alias("base_selling_price"),
        (F.col("id") % 10 != 9).alias("is_active"))


def sizes(t: Tables) -> DataFrame:
    """One size per recipe: every 7th custom, every 17th inactive."""
    rid = t.part.select(_rid().alias("id")).distinct()
    return rid.select(
        "id", F.concat(F.lit("size "), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 7 == 0, "custom").otherwise("fixed").alias("pricing_mode"),
        F.col("id").cast("int").alias("display_order"),
        (F.col("id") % 17 != 16).alias("is_active"))


def product_types(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"),
                           F.col("r_regionkey").alias("display_order"),
                           (F.col("r_regionkey") != 4).alias("is_active"))


def phone_spelling(key: Column) -> Column:
    """Four spellings of one number, by key % 4 (from floor(key / 4))."""
    digits = F.lpad(F.floor(key / 4).cast("string"), 9, "0")
    return (F.when(key % 4 == 0, F.concat(F.lit("07"), digits))
            .when(key % 4 == 1, F.concat(F.lit("+9647"), digits))
            .when(key % 4 == 2, F.concat(F.lit("009647"), digits))
            .otherwise(F.concat(F.lit("7"), digits)))


def customers(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    phone_spelling(F.col("c_custkey")).alias("phone"),
                    F.lit(None).cast("string").alias("address"),
                    F.lit(0).alias("total_orders"), to_money(F.lit(0)).alias("total_spent"),
                    F.lit(None).cast("timestamp_ntz").alias("last_order_at"))


def _pickups(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("pickup_date"))


def requests(t: Tables) -> DataFrame:
    """Order requests: one per order with lines; recipe of the smallest part.

    excluded = parts of the order with flag <> 'A', extras = flag <> 'N'; a few
    requests carry a NULL array, a blank name or a blank phone.
    """
    li = t.lineitem
    per_order = li.groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("pickup_date"),
        F.floor(F.min("l_partkey") / 8).cast("long").alias("rid"),
        F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("l_partkey"))).alias("excluded_ids"),
        F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("extra_ids"))
    o = t.orders
    k = F.col("o_orderkey")
    return o.join(per_order, o.o_orderkey == per_order.l_orderkey).select(
        k.alias("request_id"), k.alias("seq"), F.col("o_orderdate").alias("created_at"),
        (F.col("rid") % 5).alias("product_type_id"), F.col("rid").alias("size_id"),
        F.when(k % 97 == 0, F.lit("  ")).otherwise(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")))
         .alias("customer_name"),
        F.when(k % 89 == 0, F.lit(" ")).otherwise(phone_spelling(F.col("o_custkey"))).alias("customer_phone"),
        "pickup_date",
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.format_string("%02d:00:00", (k % 24).cast("int")))
         .alias("pickup_time"),
        F.lit(None).cast("string").alias("customer_notes"),
        F.when(k % 3 == 0, F.concat(F.lit("address "), k.cast("string"))).alias("customer_address"),
        F.when(k % 50 == 8, F.lit(None)).otherwise(F.col("excluded_ids")).alias("excluded_ids"),
        F.when(k % 50 == 7, F.lit(None)).otherwise(F.col("extra_ids")).alias("extra_ids"),
        F.col("o_orderstatus").alias("status"))


def noted_requests(t: Tables) -> DataFrame:
    """The requests, with the whole text of the document of the same number as the customer's note."""
    notes = t.documents.select(F.col("doc_id").alias("request_id"), F.col("text").alias("customer_notes"))
    r = requests(t)
    return r.drop("customer_notes").join(notes, "request_id", "left").select(r.columns)


def orders(t: Tables) -> DataFrame:
    """Order facts: 'P' plays cancelled; every 10th order has no price."""
    o = t.orders
    k = F.col("o_orderkey")
    price = to_money("o_totalprice")
    cost = to_money(price * F.lit(0.7).cast("decimal(2,1)"))
    pick = _pickups(t)
    return o.join(pick, o.o_orderkey == pick.l_orderkey, "left").select(
        k.alias("id"), F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") % 5).alias("product_type_id"), F.col("o_orderpriority").alias("size_id"),
        F.col("o_orderstatus").alias("status"),
        cost.alias("subtotal_cost"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(price).alias("selling_price"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(to_money(price - cost)).alias("profit"),
        (k % 10 == 0).alias("needs_price_confirmation"),
        F.lit(None).cast("string").alias("customer_notes"),
        "pickup_date",
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.format_string("%02d:00:00", (k % 24).cast("int")))
         .alias("pickup_time"),
        F.col("o_orderdate").alias("created_at"))


def order_sizes(t: Tables) -> DataFrame:
    """Sizes of the order facts: the five order priorities."""
    return t.orders.select(F.col("o_orderpriority").alias("id")).distinct() \
        .select("id", F.col("id").alias("name"))


def order_lines(t: Tables) -> DataFrame:
    li, p = t.lineitem, t.part
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("ingredient_id"),
        F.col("p_name").alias("ingredient_name_snapshot"),
        (F.col("l_returnflag") != "R").alias("is_included"),
        to_qty("l_quantity").alias("quantity_snapshot"),
        F.when(F.col("l_returnflag") == "N", to_money(F.col("p_size") * 10))
         .when(F.col("l_returnflag") == "R", to_money(F.col("p_size") * -10))
         .otherwise(to_money(F.lit(0))).alias("price_delta_applied"),
        (F.col("p_size") % 7 == 0).alias("is_allergen"))
