"""Ops 22-25: customer identity, lifetime totals, the add/delete ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.money import to_money
from larder.functions.phones import standard_phone


def upsert_customers(existing: DataFrame, valid_orders: DataFrame, phone: str = "customer_phone",
                     name: str = "customer_name", address: str = "customer_address", seq: str = "seq",
                     created_at: str = "created_at") -> DataFrame:
    """Op 22: merge order contacts into customers by trimmed phone.

    The latest name wins; the latest non-NULL address wins (an empty string is
    a value), else the stored one stays; unseen phones are added with an id
    derived from the phone. Incoming contacts are aggregated per phone first
    (partial aggregation, so a phone with many orders is combined map-side),
    then one full outer join on the unique phone.
    """
    inc = valid_orders.select(F.trim(F.col(phone)).alias("phone"), F.trim(F.col(name)).alias("_name"),
                              F.col(address).alias("_addr"), F.col(seq).alias("_seq"),
                              F.col(created_at).alias("_created"))
    latest = inc.groupBy("phone").agg(
        F.max_by("_name", "_seq").alias("_new_name"),
        F.max_by("_addr", F.when(F.col("_addr").isNotNull(), F.col("_seq"))).alias("_new_addr"),
        F.min("_created").alias("_first_seen"))
    kinds = {f.name: f.dataType for f in existing.schema.fields}
    # What a new customer starts with, as the data model has it.
    start = {"created_at": F.col("_first_seen"), "total_orders": F.lit(0), "total_spent": F.lit(0)}
    j = existing.join(latest, "phone", "full_outer")
    return j.select(
        F.coalesce(F.col("id"), _new_id(F.col("phone"), kinds["id"])).alias("id"),
        F.coalesce("_new_name", "name").alias("name"), "phone",
        F.coalesce("_new_addr", "address").alias("address"),
        *[F.when(F.col("id").isNull(), start[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in start else F.col(c)
          for c in existing.columns if c not in ("id", "name", "phone", "address")])


def _new_id(phone: Column, kind: T.DataType) -> Column:
    """From the phone, which is unique: a SHA-256 for string ids; integer ids have only a 64-bit hash's room."""
    return F.sha2(phone, 256) if isinstance(kind, T.StringType) else F.xxhash64(phone).cast(kind)


def customer_totals(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Op 23: total_orders, total_spent (NULL price = 0), last_order_at.

    Every order counts, cancelled ones too (cancelling changes only the status).
    Orders are pre-aggregated per customer before the one-to-one join.
    """
    agg = orders.groupBy("customer_id").agg(
        F.count("id").alias("_n"), F.sum(F.coalesce(F.col("selling_price"), F.lit(0))).alias("_spent"),
        F.max("created_at").alias("_last"))
    j = customers.drop("total_orders", "total_spent", "last_order_at") \
        .join(agg, F.col("id") == F.col("customer_id"), "left").drop("customer_id")
    return (j.withColumn("total_orders", F.coalesce(F.col("_n"), F.lit(0)).cast("int"))
             .withColumn("total_spent", to_money(F.coalesce(F.col("_spent"), F.lit(0))))
             .withColumn("last_order_at", F.col("_last"))
             .drop("_n", "_spent", "_last"))


def ledger_chunks(events: DataFrame, bucket_size: int = 1 << 16) -> DataFrame:
    """Partial results of the ledger: one row per customer and chunk of at most
    `bucket_size` consecutive events of theirs.

    Events are laid out by range of (customer, seq) and sorted, and a chunk is
    cut by position in that layout, not by the value of `seq`. So a customer
    has at most (their events / `bucket_size`) + (the range partitions they span)
    + 1 chunks, however sparse `seq` is.
    """
    is_del = F.col("kind") == "delete"
    d_amt = F.when(is_del, -F.col("amount")).otherwise(F.col("amount"))
    d_cnt = F.when(is_del, F.lit(-1)).otherwise(F.lit(1))
    laid = events.select("customer_id", "seq", "ts", is_del.alias("_del"),
                         F.coalesce(d_amt, F.lit(0)).alias("_da"), d_cnt.alias("_dc")) \
        .repartitionByRange("customer_id", "seq").sortWithinPartitions("customer_id", "seq")
    ev = laid.withColumn("_pos", F.monotonically_increasing_id()) \
        .withColumn("_b", F.expr(f"_pos div {int(bucket_size)}"))
    w = Window.partitionBy("customer_id", "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_sa", F.sum("_da").over(w)).withColumn("_sc", F.sum("_dc").over(w))
    return ev.groupBy("customer_id", "_b").agg(
        F.sum("_da").alias("_a_amt"), F.sum("_dc").alias("_a_cnt"),
        F.min(F.when(F.col("_del"), F.col("_sa"))).alias("_m_amt"),
        F.min(F.when(F.col("_del"), F.col("_sc"))).alias("_m_cnt"),
        F.max_by("ts", F.when(~F.col("_del"), F.col("_pos"))).alias("_last"),
        F.max("seq").alias("_seq"))


def ledger_summary(events: DataFrame, bucket_size: int = 1 << 16) -> DataFrame:
    """The chunks of each customer merged to one row: `_s_*` sums, `_min_*` the
    least running sum over deletes (null without any), last_order_at, last seq."""
    chunks = ledger_chunks(events, bucket_size)
    before = Window.partitionBy("customer_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (chunks.withColumn("_off_amt", F.coalesce(F.sum("_a_amt").over(before), F.lit(0)))
                    .withColumn("_off_cnt", F.coalesce(F.sum("_a_cnt").over(before), F.lit(0))))
    return chunks.groupBy("customer_id").agg(
        F.sum("_a_amt").alias("_s_amt"), F.sum("_a_cnt").alias("_s_cnt"),
        F.min(F.col("_off_amt") + F.col("_m_amt")).alias("_min_amt"),
        F.min(F.col("_off_cnt") + F.col("_m_cnt")).alias("_min_cnt"),
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_b"))).alias("last_order_at"),
        F.max("_seq").alias("_last_seq"))


def customer_ledger(events: DataFrame, bucket_size: int = 1 << 16) -> DataFrame:
    """Op 24: customer totals from an ordered log of order adds and deletes.

    `events`: customer_id, seq, kind ('add' | 'delete'), amount, ts. An add
    raises the count by 1 and the total by its amount and sets last_order_at;
    a delete lowers them, clamped at 0 (`max(0, x - d)`), and leaves
    last_order_at alone.

    Exact closed form: with S_k the plain prefix sum, clamping only at deletes
    gives  final = S_n - min(0, min over deletes k of S_k)  for any signs of
    the amounts. The prefix sums are computed in two levels so no customer is
    one unbounded window: each chunk of `ledger_chunks` reduces to (sum, min
    prefix over deletes), and the per-customer combine runs over one row per
    chunk. A customer with a third of all events is spread over many tasks.
    """
    per = ledger_summary(events, bucket_size)

    def clamp(total: str, low: str) -> Column:
        return F.col(total) - F.least(F.lit(0), F.coalesce(F.col(low), F.lit(0)))

    return per.select("customer_id", clamp("_s_cnt", "_min_cnt").cast("int").alias("total_orders"),
                      to_money(clamp("_s_amt", "_min_amt")).alias("total_spent"), "last_order_at")


def standardise_phones(customers: DataFrame, phone: str = "phone") -> DataFrame:
    """Op 25: the sign-in spelling of each phone, as `phone_std`."""
    return customers.withColumn("phone_std", standard_phone(phone))


def phone_duplicates(customers: DataFrame, phone: str = "phone") -> DataFrame:
    """Op 25: customers whose phones become one number once standardised.

    Counted per standard phone with partial aggregation, then the groups of two
    or more are joined back to list their customers (one row each); no group is
    collected into a single row.
    """
    std = standardise_phones(customers, phone)
    groups = std.groupBy("phone_std").agg(F.count(F.lit(1)).alias("n_customers")).filter(F.col("n_customers") > 1)
    return std.join(groups, "phone_std").select("phone_std", "id", F.col(phone).alias("phone"), "n_customers")
