"""Registered streaming queries (ops 36-39, and order placement).

Each stages its binding's rows as Parquet files in the shared scratch folder
(under `spark.checkpoint.dir`), runs the stream over them in several
micro-batches with `availableNow` triggers, and returns a batch read of what
the sink wrote. The stream does the operator's work; the batch read only
collects its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import orders as O
from larder.plans import bindings as b
from larder.plans.q_customers import ledger_events
from larder.plans.q_orders import recipe_dim
from larder.plans.registry import _t, money_out, register
from larder.session import COMPACT, DROP_SHUFFLES, conf_set, kept_rows, scratch_path
from larder.sources.sinks import latest_rows, write_batch
from larder.streaming import (needs_between, stream_create_orders, stream_daily_sales, stream_ingredient_needs,
                              stream_ledger_summaries, stream_price_orders, stream_summary_ledger)
from larder.streaming.ledger import STATE_STORE, SUMMARY


#: Micro-batches that each query's input arrives in.
BATCHES = 4
#: Files of a part.
FILES = 4


def _stage(df: DataFrame, name: str) -> DataFrame:
    """A stream of the rows of `df`, in no order: a file per shuffle partition, a quarter of them a micro-batch."""
    spark = df.sparkSession
    path, files = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // BATCHES)).parquet(path)


def _arrived(df: DataFrame, by: Column, name: str) -> DataFrame:
    """A stream of the rows of `df` that came in `BATCHES` parts in the order of the number `by`, a micro-batch each.
    The files are the stream's own, and go as it has done with them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with conf_set(spark, *DROP_SHUFFLES), kept_rows(spark) as keep:
        rows = keep(df.withColumn("_by", by))
        cuts = rows.agg(F.percentile_approx("_by", [k / BATCHES for k in range(1, BATCHES)]).alias("cuts")).first()["cuts"] or []
        part = sum((F.coalesce(F.col("_by") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
        for k in range(BATCHES):  # the file source takes files in the order of their times
            (rows.where(part == k).drop("_by").repartition(FILES).write.mode("append").option("compression", COMPACT)
             .parquet(path))
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).option("cleanSource", "delete")
            .parquet(path))


def _stream_dim(t: b.Tables) -> DataFrame:
    """The recipe dimension of a stream. As each micro-batch sends it anew by way of the driver, it is broadcast only
    where it is small beside what one batch job may send; a larger one is joined by shuffle."""
    return recipe_dim(t, O.BROADCAST_BYTES // 16)


@register("stream_price_orders")
def q_stream_price_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 36 over the order requests."""
    t = _t(spark, sf_dir)
    stream = _stage(b.requests(t), "stream-requests")
    out = scratch_path(spark, "stream-priced")
    dim = _stream_dim(t).persist()  # the static side, built once for all micro-batches
    try:
        stream_price_orders(stream, b.sizes(t), dim, out, scratch_path(spark, "stream-ckpt"),
                            available_now=True).awaitTermination()
    finally:
        dim.unpersist()
    return money_out(spark.read.parquet(f"{out}/orders").select(
        "order_id", "recipe_id", "subtotal_cost", "price_adjust", "selling_price", "profit",
        "needs_price_confirmation"))


@register("stream_create_orders")
def q_stream_create_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order placement over the requests, arriving in time order: the orders as stored."""
    t = _t(spark, sf_dir)
    out, ckpt = scratch_path(spark, "stream-placed"), scratch_path(spark, "stream-ckpt")
    customers, sizes = b.customers(t), b.sizes(t)
    dim = _stream_dim(t).persist()
    try:
        stream = _arrived(b.noted_requests(t), F.unix_micros(F.col("created_at").cast("timestamp")), "stream-place-in")
        stream_create_orders(stream, sizes, dim, customers, out, ckpt, available_now=True).awaitTermination()
    finally:
        dim.unpersist()
    return money_out(spark.read.parquet(f"{out}/orders").drop("batch_id"))


def _line_events(t: b.Tables) -> DataFrame:
    """Order lines with their order's pickup day; a 'P' order's lines arrive a
    second time with negated quantity (its cancellation)."""
    o = b.orders(t).select(F.col("id").alias("order_id"), "pickup_date", "status")
    placed = b.order_lines(t).join(o, "order_id").select(
        "order_id", "ingredient_id", "ingredient_name_snapshot", "is_included", "quantity_snapshot",
        "pickup_date", "status")
    cancels = placed.filter(F.col("status") == b.CANCELLED) \
        .withColumn("quantity_snapshot", -F.col("quantity_snapshot"))
    return placed.unionByName(cancels).drop("status")


@register("stream_ingredient_needs")
def q_stream_ingredient_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 37's kept state, then the same date range as `ingredient_needs`. Each
    micro-batch writes the keys it changed under its batch id."""
    t = _t(spark, sf_dir)
    out = scratch_path(spark, "stream-needs")
    agg = stream_ingredient_needs(_stage(_line_events(t), "stream-lines"), b.ingredients(t))
    (agg.writeStream.outputMode("update").foreachBatch(lambda df, bid: write_batch(df, out, bid))
        .option("checkpointLocation", scratch_path(spark, "stream-ckpt"))
        .trigger(availableNow=True).start().awaitTermination())
    state = latest_rows(spark.read.parquet(out), ["pickup_date", "ingredient_id", "ingredient_name_snapshot", "unit"])
    return money_out(needs_between(state, b.TODAY, b.WEEK_END))


@register("stream_customer_ledger")
def q_stream_customer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 39 over the order add/delete log, arriving in seq order: each micro-batch reduced to a row per
    customer, these folded into state; each customer's latest emitted row is its state."""
    t = _t(spark, sf_dir)
    events = ledger_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    made, out = scratch_path(spark, "stream-ledger-sums"), scratch_path(spark, "stream-ledger-out")
    stream = _arrived(events, F.col("seq"), "stream-ledger-in")
    stream_ledger_summaries(stream, made, scratch_path(spark, "stream-ckpt"), available_now=True).awaitTermination()
    sums = spark.readStream.schema(SUMMARY).option("maxFilesPerTrigger", FILES).parquet(made)
    with conf_set(spark, *STATE_STORE):
        (stream_summary_ledger(sums).writeStream.outputMode("update")
         .foreachBatch(lambda df, bid: write_batch(df, out, bid))
         .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).trigger(availableNow=True).start().awaitTermination())
    latest = latest_rows(spark.read.parquet(out), ["customer_id"])
    return latest.select("customer_id", "total_orders",
                         F.col("total_spent").cast("decimal(12,2)").cast("double").alias("total_spent"),
                         F.col("last_order_at").cast("timestamp_ntz").alias("last_order_at"))


@register("stream_daily_sales")
def q_stream_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 38 over the order facts, arriving in time order, in `update` mode:
    every day, the days still open included."""
    t = _t(spark, sf_dir)
    facts = b.orders(t).select("id", "status", "selling_price", "profit", "created_at")
    out, ckpt = scratch_path(spark, "stream-daily-out"), scratch_path(spark, "stream-ckpt")
    stream = _arrived(facts, F.unix_micros(F.col("created_at").cast("timestamp")), "stream-daily-in")
    (stream_daily_sales(stream, delay="1 day", cancelled=b.CANCELLED).writeStream.outputMode("update")
     .foreachBatch(lambda df, bid: write_batch(df, out, bid))
     .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    return money_out(latest_rows(spark.read.parquet(out), ["created_date"]))
