"""Placing a batch of orders: ops 9-12 and 22-23 composed.

The kitchen places one order per call (validate, price, upsert the customer
by phone, number, insert the order and its lines, bump the customer's running
totals). Here the same steps run over a whole batch or micro-batch, each as
the library's DataFrame operator.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.money import to_money
from larder.operators.customers import upsert_customers
from larder.operators.orders import check_orders, line_choices, number_orders, order_lines, price_orders
from larder.schemas import ORDER_NUMBER_PREFIX, ORDER_STATUSES, ORDERS


class Placed:
    """The outputs of placing a batch. Each is built on first use: numbering
    checkpoints the priced orders, so it runs only if `orders` is asked for;
    once it has run, the customer upsert reads the checkpointed rows instead of
    checking the requests a second time. `detailed` are the priced orders with
    their recipe's lines, where `priced` has none; `keep` is that of `number_orders`."""

    def __init__(self, priced: DataFrame, valid: DataFrame, rejected: DataFrame, customers: DataFrame,
                 start_number: int, prefix: str, detailed: DataFrame | None = None,
                 keep: Callable[[DataFrame], DataFrame] | None = None):
        self._priced, self._valid, self.rejected = priced, valid, rejected
        self._customers_in, self._start, self._prefix = customers, start_number, prefix
        self._detailed, self._keep = priced if detailed is None else detailed, keep
        self._numbered: DataFrame | None = None

    @cached_property
    def _upserted(self) -> DataFrame:
        rows = self._numbered if self._numbered is not None else self._valid
        return upsert_customers(self._customers_in, rows)

    @cached_property
    def orders(self) -> DataFrame:
        # The stored order has no lines array; leaving it out keeps the checkpoint narrow.
        self._numbered = number_orders(self._priced.drop("lines"), start=self._start, prefix=self._prefix,
                                       order_cols=("created_at", "order_id"), keep=self._keep)
        ids = self._upserted.select(F.col("id").alias("customer_id"), F.col("phone").alias("customer_phone"))
        return self._numbered.join(ids, "customer_phone", "left").withColumn("status", F.lit(ORDER_STATUSES[0]))

    @cached_property
    def next_number(self) -> int:
        """The number that follows the last one given here; runs the numbering."""
        self.orders
        return self._start + self._numbered.count()

    @cached_property
    def stored(self) -> DataFrame:
        """The orders in the shape of the stored table (`schemas.ORDERS`)."""
        made = {"id": F.col("order_id"), "admin_notes": F.lit(None).cast("string"), "updated_at": F.col("created_at")}
        return self.orders.select([made.get(n, F.col(n)).alias(n) for n in ORDERS.fieldNames()])

    @cached_property
    def confirmation(self) -> DataFrame:
        """What the customer is told: number, price, whether it is pending, pickup,
        and one row per ingredient with whether it is included. No cost leaves."""
        # The names ride along the numbering, so orders are not joined with their own lines.
        told = ["order_id", "order_number", "selling_price", "needs_price_confirmation", "pickup_date", "pickup_time"]
        rows = self._detailed.select("created_at", *[c for c in told if c != "order_number"], line_choices().alias("_told"))
        numbered = number_orders(rows, start=self._start, prefix=self._prefix, order_cols=("created_at", "order_id"),
                                 keep=self._keep)
        return numbered.select(*told, F.inline_outer("_told"))

    @cached_property
    def lines(self) -> DataFrame:
        return order_lines(self._detailed)

    @cached_property
    def customers(self) -> DataFrame:
        rows = self._numbered if self._numbered is not None else self._priced
        return add_order_totals(self._upserted, rows)


def add_order_totals(customers: DataFrame, priced: DataFrame) -> DataFrame:
    """Op 23, kept incrementally: each new order adds 1 to `total_orders`,
    its price (NULL = 0) to `total_spent`, and moves `last_order_at` to its
    time. New orders are aggregated per phone first (partial aggregation)."""
    new = priced.groupBy(F.col("customer_phone").alias("phone")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col("selling_price"), F.lit(0))).alias("_s"),
        F.max("created_at").alias("_last"))
    j = customers.join(new, "phone", "left")
    return (j.withColumn("total_orders", (F.coalesce(F.col("total_orders"), F.lit(0))
                                          + F.coalesce(F.col("_n"), F.lit(0))).cast("int"))
             .withColumn("total_spent", to_money(F.coalesce(F.col("total_spent"), F.lit(0))
                                                 + F.coalesce(F.col("_s"), F.lit(0))))
             .withColumn("last_order_at", F.greatest("_last", "last_order_at"))
             .drop("_n", "_s", "_last"))


def create_orders(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame, customers: DataFrame,
                  start_number: int = 1, prefix: str = ORDER_NUMBER_PREFIX) -> Placed:
    """Validate, price, number and snapshot a batch of order requests, and
    bring the customer table up to date.

    Orders get status "new", their number (op 12) and the id of the customer
    their trimmed phone resolves to after the upsert (op 22); customers get
    their running totals increased by the batch (op 23). Rejected requests are
    returned with their reason; nothing of theirs is written.
    """
    return place(check_orders(requests, sizes, recipe_dim), requests.columns, customers, start_number, prefix)


def place(checked: DataFrame, request_columns: list[str], customers: DataFrame, start_number: int = 1,
          prefix: str = ORDER_NUMBER_PREFIX) -> Placed:
    """`create_orders` from requests checked before, which the caller may have persisted."""
    valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = checked.filter(F.col("reject_reason").isNotNull()).select(*request_columns, "reject_reason")
    return Placed(price_orders(valid), valid, rejected, customers, start_number, prefix)


def check_and_price(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame) -> DataFrame:
    """Ops 9 and 10 in one pass over every request, in rows to be kept: without the recipe's lines, which make an order many
    times as wide as it came. A rejected request has no prices, and itself as it was checked in `_request`."""
    ok = F.col("reject_reason").isNull()
    checked = check_orders(requests, sizes, recipe_dim)
    return price_orders(checked.withColumns({"_request": F.when(~ok, F.struct(*requests.columns)),
                                             "lines": F.when(ok, F.col("lines"))})).drop("lines")


def place_priced(kept: DataFrame, recipe_dim: DataFrame, customers: DataFrame, start_number: int = 1,
                 prefix: str = ORDER_NUMBER_PREFIX, keep: Callable[[DataFrame], DataFrame] | None = None) -> Placed:
    """`place` from the rows of `check_and_price`, which the caller has kept. Orders take their lines from the dimension
    again, by their recipe, and only where lines are asked for."""
    valid = kept.filter(F.col("reject_reason").isNull()).drop("reject_reason", "_request")
    rejected = kept.filter(F.col("reject_reason").isNotNull()).select("_request.*", "reject_reason")
    lines = recipe_dim.select("recipe_id", "lines").dropDuplicates(["recipe_id"])  # one array a recipe, however often it is listed
    # The orders' choices have been made and priced: numbering needn't carry them.
    return Placed(valid.drop("excluded_ids", "extra_ids"), valid, rejected, customers, start_number, prefix,
                  valid.join(lines, "recipe_id"), keep)
