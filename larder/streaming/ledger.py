"""Op 39: the customer ledger folded per customer in arrival order.

Within a micro-batch a customer's events count in `seq` order; across
micro-batches, in arrival order, as the kitchen applies them. There are two
forms, both with one small state row per customer:

- `stream_ledger_summaries` and `stream_summary_ledger`, for any customer and
  trigger: Spark reduces a micro-batch to one summary row per customer, and
  `transformWithState` folds only these rows;
- `stream_customer_ledger`, in one query, for bounded triggers: a customer's
  raw events of a micro-batch go into one Python call.

A run of events acts on a customer's total x as x -> sum + max(x, floor), where
sum adds all amounts and floor is minus the least running sum over the deletes
(which clamp at 0). Two runs after each other act alike, so summaries merge.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators.customers import ledger_summary
from larder.sources.sinks import write_batch

OUTPUT = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("total_orders", T.IntegerType()),
    T.StructField("total_spent", T.StringType()),
    T.StructField("last_order_at", T.TimestampType()),
    T.StructField("as_of_seq", T.LongType()),
])
STATE = T.StructType([
    T.StructField("count", T.LongType()),
    T.StructField("cents", T.LongType()),
    T.StructField("last", T.TimestampType()),
    T.StructField("as_of", T.LongType()),
])


def _fold_from(start: int, deltas: np.ndarray, is_del: np.ndarray) -> int:
    """Fold x -> x + d (add) / max(0, x + d) (delete) from `start`.

    Exact closed form on the running sums A_k of the deltas:
    A_n + max(start, -min over deletes of A_k).
    """
    sums = np.cumsum(deltas)
    floor = -int(sums[is_del].min()) if is_del.any() else start
    return int(sums[-1]) + max(start, floor)


def _fold_customer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # pandas warns when Spark concatenates result frames holding an all-NULL column.
    warnings.filterwarnings("ignore", category=FutureWarning)
    pdf = pd.concat([b for b in batches if len(b)], ignore_index=True).sort_values("seq", kind="stable")
    count, cents, last, as_of = state.get if state.exists else (0, 0, None, None)
    is_del = pdf["is_delete"].to_numpy(dtype=bool)
    moved = pdf["cents"].to_numpy(dtype=np.int64)
    count = _fold_from(count, np.where(is_del, -1, 1), is_del)
    cents = _fold_from(cents, np.where(is_del, -moved, moved), is_del)
    if not is_del.all():
        newest = pdf["ts"][~is_del].iloc[-1]
        last = None if pd.isna(newest) else newest.to_pydatetime()
    seq = int(pdf["seq"].iloc[-1])
    as_of = seq if as_of is None else max(seq, as_of)
    state.update((count, cents, last, as_of))
    yield pd.DataFrame({"customer_id": pd.Series([key[0]], dtype=object), "total_orders": [count],
                        "total_spent": [str(Decimal(cents).scaleb(-2).quantize(Decimal("0.01")))],
                        "last_order_at": pd.Series([last], dtype="datetime64[ns]"), "as_of_seq": [as_of]})


def stream_customer_ledger(events_stream: DataFrame) -> DataFrame:
    """Op 39: per-customer totals over a stream of order adds and deletes.

    `events_stream`: customer_id (long), seq, kind ('add' | 'delete'), amount,
    ts (TIMESTAMP). Run in `update` mode; each batch emits the touched
    customers' current totals, with `as_of_seq`, the highest seq folded in.
    `total_spent` is exact decimal text. A Python call holds one customer's
    events of one micro-batch, so bound the trigger (`maxFilesPerTrigger` or
    `maxBytesPerTrigger`); a state row has a fixed size.
    """
    # Ship the fold by value: Python workers then need pandas and numpy, not this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cents = (F.coalesce(F.col("amount"), F.lit(0)) * 100).cast("long")
    rows = events_stream.select("customer_id", "seq", (F.col("kind") == "delete").alias("is_delete"),
                                cents.alias("cents"), "ts")
    return rows.groupBy("customer_id").applyInPandasWithState(
        _fold_customer, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


#: What one micro-batch does to one customer; `floor_*` is null where nothing was deleted.
SUMMARY = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("sum_count", T.LongType()),
    T.StructField("floor_count", T.LongType()),
    T.StructField("sum_cents", T.LongType()),
    T.StructField("floor_cents", T.LongType()),
    T.StructField("last_order_at", T.TimestampType()),
    T.StructField("as_of_seq", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])
#: transformWithState keeps its state in RocksDB.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def summarise_batch(events: DataFrame, batch_id: int, bucket_size: int = 1 << 16) -> DataFrame:
    """One `SUMMARY` row per customer of a micro-batch's events (customer_id, seq, kind, amount, ts).

    The chunks are those of op 24, so a customer with any share of the events
    is spread over tasks and no window or Python call holds all of theirs.
    """
    cents = F.coalesce(F.col("amount"), F.lit(0)) * 100
    rows = events.select("customer_id", "seq", "kind", cents.cast("long").alias("amount"), "ts")
    s = ledger_summary(rows, bucket_size)
    made = {"sum_count": "_s_cnt", "floor_count": "_min_cnt", "sum_cents": "_s_amt", "floor_cents": "_min_amt",
            "as_of_seq": "_last_seq"}
    return s.select(*[(F.lit(batch_id) if f.name == "batch_id" else -F.col(made[f.name]) if f.name.startswith("floor")
                       else F.col(made.get(f.name, f.name))).cast(f.dataType).alias(f.name) for f in SUMMARY.fields])


def stream_ledger_summaries(events_stream: DataFrame, path: str, checkpoint_location: str,
                            bucket_size: int = 1 << 16, available_now: bool = False) -> StreamingQuery:
    """Op 39, first step: each micro-batch's summaries under `path/batch_id=N`.

    A retried micro-batch replaces its own rows, with equal ones.
    """
    writer = (events_stream.writeStream
              .foreachBatch(lambda df, bid: write_batch(summarise_batch(df, bid, bucket_size).drop("batch_id"), path, bid))
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


#: Stands in for null in whole numbers, so that pandas keeps them whole; as a floor it changes nothing.
_NONE = -(1 << 63)
_FOLDED = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("count", T.LongType()),
                        T.StructField("total_spent", T.StringType()), T.StructField("last", T.LongType()),
                        T.StructField("as_of", T.LongType())])


class _FoldSummaries(StatefulProcessor):
    """State per customer: count, cents, microseconds of the last order, last seq, last micro-batch folded.

    A call has the rows of a bucket of customers, since a call costs many times what a row does; each customer's
    state is an entry of its own, of which a call reads and writes only those it has rows for.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "customer_id string", "count long, cents long, last long, as_of long, batch long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        # One row per customer and micro-batch that the trigger took up.
        found = pd.concat([f for f in rows if len(f)], ignore_index=True).sort_values("batch_id", kind="stable")
        totals: dict[str, tuple[int, ...]] = {}
        names = ("customer_id", "sum_count", "floor_count", "sum_cents", "floor_cents", "last", "as_of", "batch_id")
        for who, n, n_floor, cents, cents_floor, last, as_of, batch in zip(*(found[c].tolist() for c in names)):
            was = totals[who] if who in totals else self.totals.getValue((who,)) or (0, 0, _NONE, _NONE, -1)
            # One that was folded before was written again by a retry.
            totals[who] = tuple(was) if batch <= was[4] else (
                n + max(was[0], n_floor), cents + max(was[1], cents_floor), was[2] if last == _NONE else last, max(was[3], as_of), batch)
        for who, total in totals.items():
            self.totals.updateValue((who,), total)
        yield pd.DataFrame([(who, n, str(Decimal(cents).scaleb(-2).quantize(Decimal("0.01"))), last, as_of)
                            for who, (n, cents, last, as_of, _) in totals.items()], columns=_FOLDED.names)

    def close(self) -> None:
        pass


def stream_summary_ledger(summaries_stream: DataFrame, buckets: int = 1024) -> DataFrame:
    """Op 39, second step: the totals per customer, from a stream of `SUMMARY` rows; run it in `update` mode.

    A call gets, for one of `buckets` hash buckets of customers, one row per
    customer and micro-batch summarised since the last trigger (bound these
    with `maxFilesPerTrigger`). Micro-batches fold in the order of their ids
    and each once, however often its summaries were written. Start the query
    with `STATE_STORE` set, and keep `buckets` as long as its checkpoint.
    Output as `stream_customer_ledger`.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    whole = {"floor_count": "floor_count", "floor_cents": "floor_cents", "as_of": "as_of_seq"}
    rows = summaries_stream.select(
        F.pmod(F.hash("customer_id"), F.lit(buckets)).alias("_bucket"), F.coalesce(F.col("customer_id").cast("string"), F.lit("")).alias("customer_id"),
        "sum_count", "sum_cents", "batch_id", F.coalesce(F.unix_micros("last_order_at"), F.lit(_NONE)).alias("last"),
        *[F.coalesce(F.col(c), F.lit(_NONE)).alias(name) for name, c in whole.items()])
    folded = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_FoldSummaries(), outputStructType=_FOLDED, outputMode="update", timeMode="None")
    made = {"customer_id": F.nullif("customer_id", F.lit("")), "total_orders": F.col("count"), "total_spent": F.col("total_spent"),
            "last_order_at": F.timestamp_micros(F.nullif("last", F.lit(_NONE))), "as_of_seq": F.nullif("as_of", F.lit(_NONE))}
    return folded.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in OUTPUT.fields])
