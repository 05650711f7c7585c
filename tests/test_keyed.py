"""Keyed tables in buckets, order placement over many batches, and the two-step ledger."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pandas as pd
from pyspark.sql import functions as F

from larder.operators import customers as CU
from larder.operators import orders as O
from larder.operators.placement import create_orders
from larder.sources.keyed import KeyedTable
from larder.sources.sinks import latest_rows, write_batch
from larder.streaming import place_order_batch, stream_ledger_summaries, stream_summary_ledger, summarise_batch
from larder.streaming.ledger import STATE_STORE, SUMMARY, _FoldSummaries
from tests.seed import REQUEST_SCHEMA, request
from tests.test_streaming import _memory, _split_write


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_keyed_table_replaces_only_touched_buckets_and_survives_retries(spark, tmp_path):
    base = spark.createDataFrame([(f"k{i}" if i else None, i) for i in range(60)], "k string, v int")
    table = KeyedTable(spark, str(tmp_path / "t"), "k", base.schema, buckets=8)
    table.create(base)
    state = {r["k"]: r["v"] for r in base.collect()}
    rng = random.Random(1)
    for batch in range(12):
        keys = [f"k{rng.randrange(70)}" for _ in range(2)] + ([None] if batch % 4 == 0 else [])
        new = spark.createDataFrame([(k, batch * 100) for k in dict.fromkeys(keys)], base.schema)
        buckets = table.touched(new.select("k"))
        assert len(buckets) <= 3
        before = table.read(batch, buckets).collect()
        untouched = {f: os.path.getmtime(f) for f in _files(tmp_path / "t") if not any(f"_bucket={b}/" in f for b in buckets)}
        for attempt in range(2):  # the second time as a retry
            assert sorted(table.read(batch, buckets).collect(), key=str) == sorted(before, key=str)
            known = table.read(batch, buckets).alias("o")
            rest = known.join(new.select(F.col("k").alias("nk")), F.col("k").eqNullSafe(F.col("nk")), "left_anti")
            table.replace(rest.unionByName(new), batch, buckets)
        assert {f: os.path.getmtime(f) for f in untouched} == untouched
        state |= {r["k"]: r["v"] for r in new.collect()}
        assert {r["k"]: r["v"] for r in table.read(batch + 1).collect()} == state
    assert len({os.path.dirname(f) for f in _files(tmp_path / "t")}) <= 2 * 8


CUSTOMERS = "id string, name string, phone string, address string, total_orders int, total_spent decimal(12,2), last_order_at timestamp_ntz"


def test_twenty_placement_batches_do_work_that_does_not_grow(spark, kitchen, tmp_path):
    k, out = kitchen, str(tmp_path / "out")
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    customers = spark.createDataFrame([(f"c{i}", f"old {i}", f"077{i:04d}", None, 0, D(0), None) for i in range(40)], CUSTOMERS)
    rows = [request(f"q{i:02d}", i, "t1", "s1", [], [], name=f"n{i}", phone=f"077{i * 7 % 50:04d}") for i in range(40)]
    seen = []
    for batch in range(20):
        part = spark.createDataFrame(rows[2 * batch:2 * batch + 2], REQUEST_SCHEMA)
        place_order_batch(part, k.sizes, dim, customers, out, batch, start_number=7, buckets=4)
        seen.append((len(_files(f"{out}/customer_table")), len({os.path.dirname(f) for f in _files(f"{out}/sequence")})))
        if batch == 11:
            place_order_batch(part, k.sizes, dim, customers, out, batch, start_number=7, buckets=4)
    assert max(n for n, _ in seen[10:]) <= max(n for n, _ in seen[2:10]) and max(n for _, n in seen) == 2
    batch = create_orders(spark.createDataFrame(rows, REQUEST_SCHEMA), k.sizes, dim, customers, start_number=7)
    got = spark.read.parquet(f"{out}/orders")
    assert sorted(r["order_number"] for r in got.collect()) == sorted(r["order_number"] for r in batch.orders.collect())
    table = KeyedTable(spark, f"{out}/customer_table", "phone", customers.schema, 4).read(20)
    assert table.exceptAll(batch.customers.select(*customers.columns)).count() == 0 and table.count() == batch.customers.count()


def _log(n, customers, seed=3):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        c = 7 if seq % 3 == 0 else rng.randrange(customers)  # a third of all events
        amount = None if rng.random() < 0.05 else D(rng.randint(-500, 5000)) / 100
        out.append((c, seq * 11, "delete" if rng.random() < 0.4 else "add", amount, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq)))
    return out


EVENTS = "customer_id long, seq long, kind string, amount decimal(12,2), ts timestamp"


def test_summary_of_a_hot_customer_is_one_row_made_of_bounded_chunks(spark):
    df = spark.createDataFrame(_log(900, 30), EVENTS)
    sums = summarise_batch(df, 4, bucket_size=16)
    rows = sums.collect()
    assert len(rows) == len({r["customer_id"] for r in rows}) == df.select("customer_id").distinct().count()
    chunks = CU.ledger_chunks(df, 16).where("customer_id = 7").count()
    assert chunks >= 900 // 3 // 16
    assert sums.schema.names == SUMMARY.names and {r["batch_id"] for r in rows} == {4}
    assert summarise_batch(df.limit(0), 0).count() == 0


def test_two_step_ledger_equals_the_fold_and_folds_rewritten_batches_once(spark, tmp_path):
    df = spark.createDataFrame(_log(600, 25), EVENTS)
    src, made = _split_write(df.orderBy("seq"), str(tmp_path / "in"), 5), str(tmp_path / "sums")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_ledger_summaries(stream, made, str(tmp_path / "ckpt"), bucket_size=8, available_now=True).awaitTermination()
    assert len(os.listdir(made)) == 5
    want = {r["customer_id"]: (r["total_orders"], r["total_spent"], r["last_order_at"]) for r in CU.customer_ledger(df).collect()}
    key, store = STATE_STORE
    spark.conf.set(key, store)
    try:
        ckpt = str(tmp_path / "ckpt2")

        def run(name):
            sums = spark.readStream.schema(SUMMARY).option("maxFilesPerTrigger", 2).parquet(made)
            q = (stream_summary_ledger(sums).writeStream.foreachBatch(lambda d, i: write_batch(d, str(tmp_path / "state"), i))
                 .outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
            last = latest_rows(spark.read.parquet(str(tmp_path / "state")), ["customer_id"])
            return {r["customer_id"]: (r["total_orders"], D(r["total_spent"]), r["last_order_at"]) for r in last.collect()}

        assert run("a") == want
        # A retry of the first step writes batch 4 again, in other files: nothing is counted twice.
        again = spark.read.schema(df.schema).parquet(f"{src}/p4.parquet")
        write_batch(summarise_batch(again, 4).drop("batch_id"), made, 4)
        assert run("b") == want
    finally:
        spark.conf.unset(key)


def test_one_call_folds_all_customers_of_a_bucket():
    """Calls are per bucket, state per customer: whole numbers stay exact beside nulls, a batch counts once."""
    none, big = -(1 << 63), (1 << 60) + 1
    kept, asked = {}, []

    class Totals:
        def getValue(self, key):
            asked.append(key[0])
            return kept.get(key[0])

        def updateValue(self, key, value):
            kept[key[0]] = value

    class Handle:
        def getMapState(self, *_):
            return Totals()

    def rows(*found):
        return pd.DataFrame(found, columns=["customer_id", "sum_count", "floor_count", "sum_cents", "floor_cents", "last", "as_of", "batch_id"])

    fold = _FoldSummaries()
    fold.init(Handle())
    first = rows((str(big), 1, none, big, none, 5, 7, 1), ("", -1, 1, -50, 50, none, 3, 0), (str(big), -1, 1, -2, 2, none, 6, 0))
    out, = fold.handleInputRows((3,), iter([first[:1], first[1:]]), None)
    assert {r[0]: r[1:] for r in out.itertuples(index=False)} == {str(big): (1, "11529215046068469.77", 5, 7), "": (0, "0.00", none, 3)}
    out, = fold.handleInputRows((3,), iter([first[:1], rows((str(big), 1, none, 3, none, 8, 9, 2))]), None)
    assert [tuple(r) for r in out.itertuples(index=False)] == [(str(big), 2, "11529215046068469.80", 8, 9)]
    assert asked.count("") == 1 and asked.count(str(big)) == 2
