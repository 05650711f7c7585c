"""What a stream of placements leaves on disk besides its outputs, and that keeping less gives the same rows."""

import datetime as dt
import os
import time
from decimal import Decimal as D

from pyspark.sql import functions as F

from larder import checkpoint_dir
from larder.operators import orders as O
from larder.operators.placement import check_and_price, create_orders
from larder.plans.q_streams import BATCHES, FILES, _arrived
from larder.session import DROP_SHUFFLES, conf_set, kept_rows
from larder.sources.sinks import write_batch
from larder.streaming import place_order_batch
from tests.seed import REQUEST_SCHEMA, request

CUSTOMERS = "id string, name string, phone string, address string, total_orders int, total_spent decimal(12,2), last_order_at timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in _files(d) if os.path.basename(f).startswith("shuffle_")}


def _checkpoints(spark):
    return _files(checkpoint_dir(spark).removeprefix("file:"))


def _requests(spark, n=12):
    rows = [request(f"q{i:02d}", i, *[("t1", "s1", ["i7"], []), ("t2", "s2", ["i1"], None), ("t2", "s1", [], ["i14"]), ("t9", "s1", [], [])][i % 4],
                    phone=f"077{i % 5:04d}") for i in range(n)]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def test_a_placed_batch_leaves_nothing_but_its_outputs(spark, kitchen, tmp_path):
    k, out = kitchen, str(tmp_path / "out")
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    customers = spark.createDataFrame([("c0", "old", "0770000", None, 0, D(0), None)], CUSTOMERS)
    reqs = _requests(spark)
    shuffled, kept = _shuffle_files(spark), _checkpoints(spark)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    place_order_batch(reqs, k.sizes, dim, customers, out, 0, buckets=4)
    for _ in range(50):  # files of exchanges go in the background
        left = _shuffle_files(spark) - shuffled
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert not _checkpoints(spark) - kept
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
    assert spark.conf.get(DROP_SHUFFLES[0], None) != DROP_SHUFFLES[1]
    assert {d for d in os.listdir(out)} == {"orders", "order_lines", "rejected", "customers", "customer_table", "sequence"}


def test_kept_rows_of_a_batch_are_without_recipe_lines(spark, kitchen):
    k, reqs = kitchen, _requests(spark)
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    rows = check_and_price(reqs, k.sizes, dim)
    assert "lines" not in rows.columns
    priced = O.price_orders(O.validate_orders(reqs, k.sizes, dim)[0])
    names = ["order_id", "recipe_id", "subtotal_cost", "price_adjust", "selling_price", "profit", "needs_price_confirmation"]
    mine = rows.where("reject_reason is null").select(*names)
    assert sorted(mine.collect(), key=str) == sorted(priced.select(*names).collect(), key=str) and mine.count() > 0
    assert rows.where("reject_reason is not null and selling_price is not null").count() == 0


def test_recipes_listed_twice_and_requests_with_columns_of_their_own_give_the_batch_code_s_rows(spark, kitchen, tmp_path):
    """Lines come from the dimension a second time: a recipe that it lists twice makes two orders, as it did, and not four of each line."""
    k, out = kitchen, str(tmp_path / "out")
    dim = O.recipe_dimension(k.recipes.unionByName(k.recipes), k.lines, k.ingredients)
    customers = spark.createDataFrame([], CUSTOMERS)
    reqs = _requests(spark).withColumn("selling_price", F.lit("told by the caller"))
    place_order_batch(reqs, k.sizes, dim, customers, out, 0, buckets=2)
    batch = create_orders(reqs, k.sizes, dim, customers)
    for name, want in (("order_lines", batch.lines), ("rejected", batch.rejected)):
        got = spark.read.parquet(f"{out}/{name}").drop("batch_id")
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0, name
    orders = spark.read.parquet(f"{out}/orders")
    assert sorted(r["order_number"] for r in orders.collect()) == sorted(r["order_number"] for r in batch.stored.collect())


def test_numbers_from_kept_rows_are_those_from_a_checkpoint(spark):
    rows = spark.range(500).select(F.col("id").alias("request_id"), (F.lit(START) + F.make_interval(hours=F.col("id") * 7 % 50)).alias("created_at"))
    before = _checkpoints(spark)
    with kept_rows(spark) as keep:
        got = {r["request_id"]: r["order_number"] for r in O.number_orders(rows, 9990, num_partitions=7, keep=keep).collect()}
        assert _checkpoints(spark) - before
    assert not _checkpoints(spark) - before
    assert got == {r["request_id"]: r["order_number"] for r in O.number_orders(rows, 9990, num_partitions=7).collect()}
    assert len(set(got.values())) == 500


def test_staged_input_comes_in_order_and_goes_as_the_stream_reads_it(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") * 37 % 400).alias("at"), F.when(F.col("id") % 9 != 0, F.lit("note")).alias("note"))
    cached, kept = spark.sparkContext._jsc.getPersistentRDDs().size(), _checkpoints(spark)
    stream = _arrived(rows, F.col("at"), "disk-in")
    staged = {f for f in _checkpoints(spark) - kept if f.endswith(".parquet")}
    assert len(staged) == BATCHES * FILES
    assert len({os.path.dirname(f) for f in staged}) == 1  # and nothing of what they were made from
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
    out, left = str(tmp_path / "out"), []

    def write(df, batch):
        write_batch(df, out, batch)
        time.sleep(1)  # files of the batch before go in the background
        left.append(sum(map(os.path.exists, staged)))

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
     .awaitTermination())
    got = spark.read.parquet(out)
    assert sorted(got.drop("batch_id").collect(), key=str) == sorted(rows.collect(), key=str)
    spans = got.groupBy("batch_id").agg(F.min("at"), F.max("at")).orderBy("batch_id").collect()
    assert len(spans) == BATCHES and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    assert left == sorted(left, reverse=True) and left[-1] <= 2 * FILES


def test_a_setting_is_put_back(spark):
    with conf_set(spark, *DROP_SHUFFLES):
        assert spark.conf.get(DROP_SHUFFLES[0]) == "true"
    assert spark.conf.get(DROP_SHUFFLES[0]) != "true"
