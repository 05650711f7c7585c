"""Ops 14-21: enriched order facts and the admin lists built on them.

Lists with a row cap take the top-k on the orders first (`TakeOrderedAndProject`:
a per-partition top-k, then a merge), and only then look up names for those
few rows, so a 200-row board never joins the whole customer table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.schemas import ALLERGY_NOTE_PATTERN, CANCELLED


def _names(customers: DataFrame, types: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                         F.col("phone").alias("customer_phone"))
    t = types.select(F.col("id").alias("product_type_id"), F.col("name").alias("type_name"))
    s = sizes.select(F.col("id").alias("size_id"), F.col("name").alias("size_name"))
    return c, t, s


def order_facts(orders: DataFrame, customers: DataFrame, types: DataFrame, sizes: DataFrame) -> DataFrame:
    """Op 14: orders with customer name and phone, type and size names.

    Spark picks each join by the sides' bytes; AQE splits a customer holding
    many orders.
    """
    c, t, s = _names(customers, types, sizes)
    return (orders.join(c, "customer_id", "left")
                  .join(t, "product_type_id", "left")
                  .join(s, "size_id", "left"))


def enrich_few(top: DataFrame, customers: DataFrame, types: DataFrame, sizes: DataFrame) -> DataFrame:
    """Op 14 for a row-capped list: `top` holds at most its limit of rows.

    The customers needed are cut down by a semi join against the broadcast
    customer ids of `top` (bounded by the cap), then joined back as a broadcast.
    """
    c, t, s = _names(customers, types, sizes)
    ids = top.select("customer_id").distinct()
    needed = c.join(F.broadcast(ids), "customer_id", "left_semi")
    return (top.join(F.broadcast(needed), "customer_id", "left")
               .join(t, "product_type_id", "left")
               .join(s, "size_id", "left"))


def _enriched(orders: DataFrame, order: list[Column], limit: int | None, customers: DataFrame, types: DataFrame,
              sizes: DataFrame) -> DataFrame:
    if limit is None:
        return order_facts(orders, customers, types, sizes)
    return enrich_few(orders.orderBy(*order).limit(limit), customers, types, sizes)


def _allergy_note(pattern: str) -> Column:
    return F.coalesce(F.col("customer_notes").rlike(pattern), F.lit(False))


def order_board(orders: DataFrame, customers: DataFrame, types: DataFrame, sizes: DataFrame,
                status: str | None = None, limit: int | None = None,
                allergy_pattern: str = ALLERGY_NOTE_PATTERN) -> DataFrame:
    """Op 15: newest orders first, optional status filter, with price-pending
    and allergy-note flags; the first `limit` if the caller states one."""
    o = orders if status is None else orders.filter(F.col("status") == status)
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return (_enriched(o, newest, limit, customers, types, sizes)
            .withColumn("price_pending", F.coalesce(F.col("needs_price_confirmation"), F.lit(False)))
            .withColumn("allergy_note", _allergy_note(allergy_pattern))
            .orderBy(*newest))


def pickups_on(facts: DataFrame, day: str | dt.date) -> DataFrame:
    """Op 16: the day's pickups by time (NULL times last); cancelled included."""
    return facts.filter(F.col("pickup_date") == F.lit(dt.date.fromisoformat(str(day)))) \
        .orderBy(F.col("pickup_time").asc_nulls_last(), "id")


def upcoming_orders(orders: DataFrame, customers: DataFrame, types: DataFrame, sizes: DataFrame,
                    day: str | dt.date, limit: int | None = None, cancelled: str = CANCELLED) -> DataFrame:
    """Op 17: pickups after `day`, cancelled excluded; the first `limit` if the caller states one."""
    d = F.lit(dt.date.fromisoformat(str(day)))
    key = [F.col("pickup_date").asc(), F.col("pickup_time").asc_nulls_last(), F.col("id").asc()]
    ahead = orders.filter((F.col("pickup_date") > d) & (F.col("status") != cancelled))
    return _enriched(ahead, key, limit, customers, types, sizes).orderBy(*key)


def customer_list(customers: DataFrame) -> DataFrame:
    """Op 18: by last order, newest first, never-ordered last."""
    return customers.orderBy(F.col("last_order_at").desc_nulls_last(), F.col("id"))


def customer_history(orders: DataFrame, customer_ids: DataFrame) -> DataFrame:
    """Op 19: orders of the given customers, newest first."""
    ids = customer_ids.select(F.col(customer_ids.columns[0]).alias("customer_id")).distinct()
    return orders.join(ids, "customer_id", "left_semi") \
        .orderBy("customer_id", F.col("created_at").desc(), F.col("id").desc())


def order_detail(lines: DataFrame, order_ids: DataFrame) -> DataFrame:
    """Op 20: selected and left-out lines of the given orders, by name, with the
    allergen flag and the signed price delta (shown only when non-zero)."""
    ids = order_ids.select(F.col(order_ids.columns[0]).alias("order_id")).distinct()
    delta = F.col("price_delta_applied")
    return (lines.join(ids, "order_id", "left_semi")
            .select("order_id", "ingredient_id", "ingredient_name_snapshot", "is_included", "is_allergen",
                    delta.alias("signed_delta"), (F.coalesce(delta, F.lit(0)) != 0).alias("delta_shown"))
            .orderBy("order_id", "ingredient_name_snapshot", "ingredient_id"))


def flag_allergy_notes(orders: DataFrame, lines: DataFrame | None = None,
                       pattern: str = ALLERGY_NOTE_PATTERN) -> DataFrame:
    """Op 21: note mentions an allergy (NULL note is false); and, given lines,
    the order has an included allergen line (pre-aggregated per order)."""
    out = orders.withColumn("allergy_note", _allergy_note(pattern))
    if lines is None:
        return out
    hit = (lines.filter(F.col("is_included") & F.col("is_allergen"))
           .groupBy(F.col("order_id").alias("id")).agg(F.lit(True).alias("allergen_line")))
    return out.join(hit, "id", "left").withColumn("allergen_line", F.coalesce("allergen_line", F.lit(False)))
