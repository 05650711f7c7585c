"""Ops 36-38: Structured Streaming forms of order pricing, order placement and two reports.

The semantics are those of the batch operators; the streaming part is only
the state and the sink.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larder.operators.orders import check_orders, order_lines, price_orders
from larder.operators.placement import check_and_price, place_priced
from larder.schemas import CANCELLED, ORDER_NUMBER_PREFIX
from larder.session import DROP_SHUFFLES, conf_set, kept_rows
from larder.sources.keyed import KeyedTable
from larder.sources.sinks import write_batch


def _checked(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame) -> DataFrame:
    """A micro-batch checked once, to be persisted and read by several outputs. Each order carries its recipe's lines, so it is
    many times as wide as it came: rebalanced, so that a task reads a share of bounded size however few files the batch came in."""
    return check_orders(requests, sizes, recipe_dim).hint("rebalance", "request_id")


def process_order_batch(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame, out_path: str,
                        batch_id: int) -> None:
    """Ops 9-11 on one micro-batch; orders, lines and rejects go under
    `batch_id=N` with overwrite, so a retried batch replaces its own output.
    The checked batch (one join with the static side) is persisted once and
    all three outputs are derived from it."""
    checked = _checked(requests, sizes, recipe_dim).persist()
    try:
        valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
        priced = price_orders(valid)
        write_batch(priced.drop("lines"), f"{out_path}/orders", batch_id)
        write_batch(order_lines(priced), f"{out_path}/order_lines", batch_id)
        write_batch(checked.filter(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason"),
                    f"{out_path}/rejected", batch_id)
    finally:
        checked.unpersist()


def stream_price_orders(requests_stream: DataFrame, sizes: DataFrame, recipe_dim: DataFrame, out_path: str,
                        checkpoint_location: str, available_now: bool = False) -> StreamingQuery:
    """Op 36: price a stream of order requests; stateless and row-wise.

    Each micro-batch is validated and priced by the batch code against the
    static recipe dimension, then written idempotently by batch id. For a
    long-running stream, persist `recipe_dim` first (it is then recomputed from
    its lineage only if an executor is lost) and unpersist it after the stream.
    """
    writer = (requests_stream.writeStream
              .foreachBatch(lambda df, bid: process_order_batch(df, sizes, recipe_dim, out_path, bid))
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _last_number(spark: SparkSession, path: str, batch_id: int, start_number: int) -> int:
    """The order number after those of earlier batches; the newest two batches are kept, in turn."""
    if batch_id == 0:
        return start_number
    kept = spark.read.schema("batch_id long, next_number long, turn int").parquet(path)
    last = kept.where(F.col("batch_id") < batch_id).agg(F.max_by("next_number", "batch_id")).first()[0]
    return start_number if last is None else last


def place_order_batch(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame, customers: DataFrame,
                      out_path: str, batch_id: int, start_number: int = 1, prefix: str = ORDER_NUMBER_PREFIX,
                      buckets: int = 64) -> None:
    """`create_orders` on one micro-batch. Orders as stored, lines, rejects and
    the customers it touched go under `batch_id=N`; the customer table as it
    then stands is kept in buckets of the phone (`customer_table`).

    The checked and priced batch is kept compressed and without its recipes'
    lines, and it, the numbered orders and the exchanges' files go with the batch:
    what is on disk besides the outputs doesn't grow with the batches run either.

    A batch reads the number its predecessor ended with and the buckets of its
    own phones, so its work doesn't grow with the batches run. What it reads is
    what earlier batches wrote and nothing of its own, so a retried batch gives
    the same and replaces its output. Batch 0 lays `customers` out.
    """
    spark = requests.sparkSession
    table = KeyedTable(spark, f"{out_path}/customer_table", "phone", customers.schema, buckets)
    with conf_set(spark, *DROP_SHUFFLES), kept_rows(spark) as keep:
        if batch_id == 0:
            table.create(customers)
        start = _last_number(spark, f"{out_path}/sequence", batch_id, start_number)
        # Rebalanced while narrow, so that a task checks and prices a share however few files the batch came in.
        kept = keep(check_and_price(requests.hint("rebalance", "request_id"), sizes, recipe_dim))
        phones = kept.filter(F.col("reject_reason").isNull()).select(F.col("customer_phone").alias("phone")).distinct()
        touched = table.touched(phones)
        known = table.read(batch_id, touched)
        mine = known.join(phones, "phone", "left_semi").select(*customers.columns)
        placed = place_priced(kept, recipe_dim, mine, start, prefix, keep)
        write_batch(placed.stored, f"{out_path}/orders", batch_id)  # numbers, and so fixes, the orders
        changed = placed.customers.select(*customers.columns)

        def keep_customers() -> None:
            path = f"{out_path}/customers"
            write_batch(changed, path, batch_id)
            done = spark.read.schema(customers.schema).parquet(f"{path}/batch_id={batch_id}")
            table.replace(known.join(phones, "phone", "left_anti").select(*customers.columns).unionByName(done), batch_id, touched)

        def keep_number() -> None:
            row = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"),
                                        F.lit(placed.next_number).cast("long").alias("next_number"))
            row.write.mode("overwrite").parquet(f"{out_path}/sequence/turn={batch_id % 2}")

        _together(spark, [lambda: write_batch(placed.lines, f"{out_path}/order_lines", batch_id), keep_customers, keep_number,
                          lambda: write_batch(placed.rejected, f"{out_path}/rejected", batch_id)])


def _together(spark: SparkSession, jobs: list[Callable[[], None]]) -> None:
    """Independent jobs at the same time, so that small ones don't wait for each other; the first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def stream_create_orders(requests_stream: DataFrame, sizes: DataFrame, recipe_dim: DataFrame, customers: DataFrame,
                         out_path: str, checkpoint_location: str, start_number: int = 1,
                         available_now: bool = False, buckets: int = 64) -> StreamingQuery:
    """Order placement on a stream: the batch code on every micro-batch, with
    numbers and customers going on across batches.

    `customers` is the table as it stood before the stream; as it stands since,
    it is kept in `buckets` under `out_path/customer_table`, and what each batch
    changed under `out_path/customers` (`latest_rows` by phone). Take about as
    many buckets as give 100 MB each. Orders are numbered in creation order
    within a micro-batch, and batches in the order they arrive. Of a customer's
    contacts the last batch's count.
    """
    writer = (requests_stream.writeStream
              .foreachBatch(lambda df, bid: place_order_batch(df, sizes, recipe_dim, customers, out_path, bid, start_number,
                                                              buckets=buckets))
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_ingredient_needs(lines_stream: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Op 37: included quantity per (pickup date, ingredient, snapshot name,
    current unit), kept as streaming state; run it in `update` (or
    `complete`) mode.

    `lines_stream` holds order lines with their order's pickup date. A
    cancellation arrives as the same lines with negative quantity. The unit
    comes from a stream-static join with the ingredient catalog. No watermark: pickups lie ahead of the order, so one on
    pickup would drop near pickups. The state is bounded by calendar days x
    catalog, not by the number of orders.
    """
    unit = ingredients.select(F.col("id").alias("ingredient_id"), "unit")
    return (lines_stream.filter(F.col("is_included"))
            .join(unit, "ingredient_id")
            .groupBy("pickup_date", "ingredient_id", "ingredient_name_snapshot", "unit")
            .agg(F.sum("quantity_snapshot").alias("total_quantity")))


def needs_between(needs_state: DataFrame, d1: str | dt.date, d2: str | dt.date) -> DataFrame:
    """Op 26 answered from op 37's kept rows: sum the days in [d1, d2]."""
    d1 = dt.date.fromisoformat(str(d1))
    d2 = dt.date.fromisoformat(str(d2))
    return (needs_state.filter(F.col("pickup_date").between(F.lit(d1), F.lit(d2)))
            .groupBy("ingredient_id", F.col("ingredient_name_snapshot").alias("ingredient_name"), "unit")
            .agg(F.sum("total_quantity").alias("total_quantity"))
            .filter(F.col("total_quantity") != 0))


def stream_daily_sales(orders_stream: DataFrame, delay: str = "1 day", cancelled: str = CANCELLED,
                       report_tz: str = "UTC") -> DataFrame:
    """Op 38: op 30 per created day, over a stream; run it in `append` or `update` mode.

    In `update` mode each micro-batch emits the days it touched with their
    totals so far, open days included: a day's latest row holds its total
    (`latest_rows`). In `append` mode a day is emitted once, when the watermark (latest event time - `delay`)
    passes its end, and its state is then dropped. Rows within `delay` are
    always counted; rows later than that may or may not be (Spark's watermark
    contract), and never after their day was emitted. Days are calendar days in
    `report_tz` (a TIMESTAMP_NTZ column is already wall-clock time), whatever
    the session time zone: event times are shifted to report-zone wall clock
    before the tumbling window, and the day is read off the window start in
    epoch seconds. `withWatermark` needs a TIMESTAMP column, hence the cast.
    """
    c = F.col("created_at")
    if isinstance(orders_stream.schema["created_at"].dataType, T.TimestampNTZType):
        session_tz = orders_stream.sparkSession.conf.get("spark.sql.session.timeZone")
        local = F.from_utc_timestamp(c.cast("timestamp"), session_tz)
    else:
        local = F.from_utc_timestamp(c, report_tz)
    live = orders_stream.filter(~F.col("status").eqNullSafe(F.lit(cancelled))).withColumn("_local", local)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("day.start")) / 86400).cast("int"))
    return (live.withWatermark("_local", delay)
            .groupBy(F.window("_local", "1 day").alias("day"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum(F.coalesce(F.col("selling_price"), F.lit(0))).alias("sales"),
                 F.sum(F.coalesce(F.col("profit"), F.lit(0))).alias("profit"))
            .select(day.alias("created_date"), "order_count", "sales", "profit"))
