"""Op 2: append priced orders and their lines.

Facts are partitioned by created date so date-bounded reports prune whole
folders. Streaming writes go to `batch_id=N` folders with overwrite, so a
retried micro-batch replaces its own output instead of duplicating it; batch
loads do the same under a `load_id` (`write_load`). `save_co_located` keeps
orders and lines in like buckets of the order id, so their joins move neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import COMPACT


def _with_created_date(df: DataFrame) -> DataFrame:
    # Rebalanced by day: few files for a small day, and a hot day is split.
    return df.withColumn("created_date", F.to_date("created_at")).hint("rebalance", "created_date")


def write_orders(priced: DataFrame, path: str, mode: str = "append") -> None:
    cols = [c for c in priced.columns if c != "lines"]
    _with_created_date(priced.select(*cols)).write.mode(mode).partitionBy("created_date").parquet(path)


def write_order_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    _with_created_date(lines).write.mode(mode).partitionBy("created_date").parquet(path)


def write_load(facts: DataFrame, path: str, load_id: str) -> None:
    """Append one load of orders or lines so that running it again doesn't double its rows.

    Folders are (created_date, load_id), and of these only the load's own are
    replaced, when the job commits: a job that dies leaves nothing to be read,
    and a second run takes the place of the first. A load run again must hold
    the same days; a day that it no longer has keeps its earlier rows.
    """
    rows = _with_created_date(facts.drop("lines")).withColumn("load_id", F.lit(load_id))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("created_date", "load_id").parquet(path))


def save_co_located(orders: DataFrame, lines: DataFrame, orders_table: str, lines_table: str, buckets: int,
                    mode: str = "overwrite") -> None:
    """Save orders and their lines as tables, each in `buckets` files sorted by order id.

    What joins the two on the order id (ops 20, 26, 27) then reads like buckets
    side by side, without an exchange or a sort of the lines. Take as many
    buckets as give a few hundred MB of lines each. Orders have `id`, lines `order_id`.
    """
    for rows, key, name in ((orders, "id", orders_table), (lines, "order_id", lines_table)):
        # Dealt as the buckets are, so that each bucket is one file.
        (rows.drop("lines").repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet")
         .saveAsTable(name))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent per-batch write: a retry of batch N overwrites batch N only."""
    df.write.mode("overwrite").option("compression", COMPACT).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def latest_rows(written: DataFrame, keys: list[str]) -> DataFrame:
    """The state that an `update` stream has reached: of each key, the row of its
    last batch. `written` is what `write_batch` wrote, with its `batch_id`."""
    values = [c for c in written.columns if c not in (*keys, "batch_id")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in values])
