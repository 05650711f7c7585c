"""Batch = stream for ops 36-39, with availableNow over split input files."""

import datetime as dt
import os
import time
from decimal import Decimal as D


from larder.operators import customers as CU
from larder.operators import orders as O
from larder.operators import reports as R
from larder.streaming import (needs_between, stream_customer_ledger, stream_daily_sales,
                              stream_ingredient_needs, stream_price_orders, stream_create_orders)
from tests.seed import REQUEST_SCHEMA, request


def _split_write(df, path, parts):
    """Write `df` as `parts` contiguous chunks, one file each, with increasing
    modification times (the file source reads files in that order)."""
    rows = df.collect()
    for i in range(parts):
        chunk = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("overwrite") \
            .parquet(f"{path}/part{i}")
    base = time.time() - 1000
    files = []
    for i in range(parts):
        d = f"{path}/part{i}"
        for f in os.listdir(d):
            if f.endswith(".parquet"):
                files.append((i, os.path.join(d, f)))
    flat = f"{path}/flat"
    os.makedirs(flat)
    for i, f in files:
        target = os.path.join(flat, f"p{i}.parquet")
        os.link(f, target)
        os.utime(target, (base + i * 10, base + i * 10))
    return flat


def _memory(sdf, name, mode):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sdf.sparkSession.table(name)


def test_stream_create_orders_numbers_on_and_keeps_customers(spark, kitchen, tmp_path):
    """Two runs of a stream over three micro-batches: numbers go on, customers' totals are the batch's, a retry changes nothing."""
    from larder.operators.placement import create_orders
    from larder.sources.sinks import latest_rows
    from larder.streaming import place_order_batch
    k = kitchen
    reqs = spark.createDataFrame(
        [request(f"q{i}", i, t, s, ex, xt) for i, (t, s, ex, xt) in enumerate(
            [("t1", "s1", ["i7"], []), ("t2", "s1", [], ["i14"]), ("t1", "s3", [], []), ("t2", "s2", ["i1"], None),
             ("t3", "s2", ["i2", "i3"], []), ("t2", "s1", None, ["i14", "i14"]), ("t2", "s1", [], [])])], REQUEST_SCHEMA)
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    customers = spark.createDataFrame([], "id string, name string, phone string, address string, total_orders int, "
                                          "total_spent decimal(12,2), last_order_at timestamp_ntz")
    src, out = _split_write(reqs, str(tmp_path / "in"), 3), str(tmp_path / "out")
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_create_orders(stream, k.sizes, dim, customers, out, str(tmp_path / "ckpt"), start_number=9998,
                         available_now=True).awaitTermination()
    batch = create_orders(reqs, k.sizes, dim, customers, start_number=9998)

    def placed():
        return sorted((r["id"], r["order_number"], r["customer_id"], r["selling_price"], r["batch_id"])
                      for r in spark.read.parquet(f"{out}/orders").collect())

    got = placed()
    assert [x[:4] for x in got] == sorted((r["id"], r["order_number"], r["customer_id"], r["selling_price"]) for r in batch.stored.collect())
    assert len({x[4] for x in got}) > 1
    names = customers.columns
    assert latest_rows(spark.read.parquet(f"{out}/customers"), ["phone"]).select(*names).exceptAll(batch.customers.select(*names)).count() == 0
    last = max(x[4] for x in got)
    again = spark.read.schema(reqs.schema).parquet(f"{src}/p{last}.parquet")
    place_order_batch(again, k.sizes, dim, customers, out, last, start_number=9998)
    assert placed() == got
    assert spark.read.parquet(f"{out}/rejected").count() == batch.rejected.count()


def test_stream_price_orders_equals_batch(spark, kitchen, tmp_path):
    k = kitchen
    reqs = spark.createDataFrame(
        [request(f"q{i}", i, t, s, ex, xt) for i, (t, s, ex, xt) in enumerate(
            [("t1", "s1", ["i7"], []), ("t2", "s1", [], ["i14"]), ("t1", "s3", [], []), ("t2", "s2", ["i1"], None),
             ("t3", "s2", ["i2", "i3"], []), ("t2", "s1", None, ["i14", "i14"])])], REQUEST_SCHEMA)
    src = _split_write(reqs, str(tmp_path / "in"), 3)
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_price_orders(stream, k.sizes, dim, out, str(tmp_path / "ckpt"), available_now=True).awaitTermination()
    valid, rejected = O.validate_orders(reqs, k.sizes, dim)
    batch = O.price_orders(valid).select("order_id", "subtotal_cost", "selling_price", "profit")
    streamed = spark.read.parquet(f"{out}/orders").select("order_id", "subtotal_cost", "selling_price", "profit")
    assert sorted(batch.collect()) == sorted(streamed.collect())
    assert spark.read.parquet(f"{out}/orders").select("batch_id").distinct().count() == 3
    assert spark.read.parquet(f"{out}/order_lines").count() == O.order_lines(O.price_orders(valid)).count()
    assert sorted(r.request_id for r in spark.read.parquet(f"{out}/rejected").collect()) == \
        sorted(r.request_id for r in rejected.collect())


def test_stream_ingredient_needs_with_cancellation(spark, kitchen, tmp_path):
    rows = [("o1", "i1", "onion", True, D("1.000"), dt.date(2024, 1, 2)),
            ("o1", "i2", "tomato", False, D("2.000"), dt.date(2024, 1, 2)),
            ("o2", "i1", "onion", True, D("0.500"), dt.date(2024, 1, 3)),
            ("o3", "i1", "onion", True, D("4.000"), dt.date(2024, 1, 9)),
            ("o2", "i1", "onion", True, D("-0.500"), dt.date(2024, 1, 3))]  # o2 cancelled
    schema = ("order_id string, ingredient_id string, ingredient_name_snapshot string, "
              "is_included boolean, quantity_snapshot decimal(12,3), pickup_date date")
    df = spark.createDataFrame(rows, schema)
    src = _split_write(df, str(tmp_path / "in"), 2)
    state = _memory(stream_ingredient_needs(spark.readStream.schema(df.schema).parquet(src), kitchen.ingredients),
                    "needs_t", "complete")
    got = {(r.ingredient_id, r.unit, r.total_quantity)
           for r in needs_between(state, "2024-01-01", "2024-01-07").collect()}
    assert got == {("i1", "kg", D("1.000"))}


def test_stream_daily_sales_closed_days_equal_batch(spark, tmp_path):
    rows = []
    for day in range(6):
        for j in range(3):
            ts = dt.datetime(2024, 1, 1 + day, 8 + j)
            rows.append((f"d{day}o{j}", "ملغي" if j == 2 else "جديد", D(100 + j), D(10 + j), ts))
    df = spark.createDataFrame(rows, "id string, status string, selling_price decimal(12,2), "
                                     "profit decimal(12,2), created_at timestamp")
    src = _split_write(df.orderBy("created_at"), str(tmp_path / "in"), 3)
    out = _memory(stream_daily_sales(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
                                     .parquet(src), delay="1 day"), "daily_t", "append")
    got = {r.created_date: (r.order_count, r.sales) for r in out.collect()}
    assert got, "no day closed"
    for d, (n, sales) in got.items():
        b = R.sales_between(df, d, d).first()
        assert (n, sales) == (b.order_count, b.sales), d


def test_stream_ledger_equals_batch(spark, tmp_path):
    ev = []
    for seq in range(40):
        c = seq % 3
        kind = "delete" if seq % 4 == 3 else "add"
        ev.append((c, seq, kind, D(seq * 7 % 50), dt.datetime(2024, 1, 1) + dt.timedelta(hours=seq)))
    df = spark.createDataFrame(ev, "customer_id long, seq long, kind string, amount decimal(12,2), ts timestamp")
    src = _split_write(df.orderBy("seq"), str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _memory(stream_customer_ledger(stream), "ledger_t", "update")
    # Update mode appends one row per touched customer per batch; the latest is the current state.
    latest = {}
    for r in sorted(out.collect(), key=lambda r: r.as_of_seq):
        latest[r.customer_id] = (r.total_orders, D(r.total_spent), r.last_order_at)
    batch = {r.customer_id: (r.total_orders, r.total_spent, r.last_order_at) for r in CU.customer_ledger(df).collect()}
    # The stream folds in arrival order; files were split in seq order, so it equals the batch fold.
    assert {k: (v[0], v[1]) for k, v in latest.items()} == {k: (v[0], v[1]) for k, v in batch.items()}


def test_stream_daily_sales_counts_rows_within_the_delay(spark, tmp_path):
    early = [(f"a{i}", "جديد", D(10), D(1), dt.datetime(2024, 1, 1 + i, 12)) for i in range(5)]  # Jan 1-5
    # After Jan 5 12:00 the watermark is Jan 4 12:00: a Jan 4 20:00 row is late but within the delay.
    within = [("w", "جديد", D(5), D(1), dt.datetime(2024, 1, 4, 20))]
    tail = [(f"b{i}", "جديد", D(10), D(1), dt.datetime(2024, 1, 8 + i, 12)) for i in range(2)]  # closes Jan 4-6
    schema = "id string, status string, selling_price decimal(12,2), profit decimal(12,2), created_at timestamp"
    df = spark.createDataFrame(early + within + tail, schema)
    src = _split_write(df, str(tmp_path / "in"), 4)
    out = _memory(stream_daily_sales(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
                                     .parquet(src), delay="1 day"), "daily_within_t", "append")
    rows = out.collect()
    got = {r.created_date: (r.order_count, r.sales) for r in rows}
    assert len(rows) == len(got)  # each day emitted once
    assert got[dt.date(2024, 1, 4)] == (2, D(15))
    assert got[dt.date(2024, 1, 1)] == (1, D(10))


def test_ledger_state_equals_fold_across_batches(spark, tmp_path):
    import random
    rnd = random.Random(5)
    ev = []
    for seq in range(300):
        c = rnd.choice([1, 2, 3]) if rnd.random() < 0.3 else rnd.randint(4, 40)
        kind = "delete" if rnd.random() < 0.35 else "add"
        amt = None if rnd.random() < 0.05 else D(rnd.randint(-500, 5000)) / 100
        ev.append((c, seq, kind, amt, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq)))
    df = spark.createDataFrame(ev, "customer_id long, seq long, kind string, amount decimal(12,2), ts timestamp")
    src = _split_write(df.orderBy("seq"), str(tmp_path / "in"), 5)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _memory(stream_customer_ledger(stream), "ledger_b3", "update")
    latest = {}
    for r in sorted(out.collect(), key=lambda r: r.as_of_seq):
        latest[r.customer_id] = (r.total_orders, D(r.total_spent), r.last_order_at)
    want = {}
    for c, seq, kind, amt, ts in ev:  # arrival order = seq order
        n, tot, last = want.get(c, (0, D(0), None))
        a = amt or D(0)
        want[c] = (max(0, n - 1), max(D(0), tot - a), last) if kind == "delete" else (n + 1, tot + a, ts)
    assert {k: (n, t.quantize(D("0.01")), last) for k, (n, t, last) in want.items()} == latest
