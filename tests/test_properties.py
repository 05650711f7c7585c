"""Properties and brute-force checks on generated inputs."""

import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from larder.operators import changes as CH
from larder.operators import customers as CU
from larder.operators import orders as O
from larder.plans import bindings as b

SF = "/root/testdata/sf0.001"


def _priced(spark):
    t = b.Tables(spark, SF)
    dim = O.recipe_dimension(b.recipes(t), b.recipe_lines(t), b.ingredients(t))
    reqs = b.requests(t)
    valid, rejected = O.validate_orders(reqs, b.sizes(t), dim)
    return t, reqs, valid, rejected, O.price_orders(valid)


def test_valid_and_rejected_partition_the_input(spark):
    _, reqs, valid, rejected, _ = _priced(spark)
    assert valid.count() + rejected.count() == reqs.count()
    assert valid.join(rejected, "request_id").count() == 0


def test_subtotal_is_sum_of_lines_plus_packaging(spark):
    _, _, _, _, priced = _priced(spark)
    lines = O.order_lines(priced).groupBy("order_id").agg(F.sum("cost_snapshot").alias("s"))
    j = priced.join(lines, "order_id", "left").select(
        "subtotal_cost", (F.coalesce("s", F.lit(0)) + F.col("packaging_cost") + F.col("extra_cost")).alias("x"))
    assert j.filter(F.col("subtotal_cost") != F.col("x")).count() == 0


def test_pricing_ignores_array_order(spark):
    _, _, valid, _, priced = _priced(spark)
    shuffled = valid.withColumn("excluded_ids", F.reverse("excluded_ids")) \
        .withColumn("extra_ids", F.reverse(F.array_union("extra_ids", "extra_ids")))
    other = O.price_orders(shuffled)
    cols = ["order_id", "subtotal_cost", "selling_price", "profit"]
    assert priced.select(*cols).exceptAll(other.select(*cols)).count() == 0


def test_unselected_order_matches_costing_within_rounding(spark):
    from larder.operators.catalog import recipe_costing
    t, _, valid, _, _ = _priced(spark)
    plain = O.price_orders(valid.withColumn("excluded_ids", F.array().cast("array<bigint>"))
                           .withColumn("extra_ids", F.array().cast("array<bigint>")))
    cost = recipe_costing(b.recipes(t), b.product_types(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t))
    j = plain.join(cost.select("recipe_id", "total_cost"), "recipe_id").select(
        F.abs(F.col("subtotal_cost") - F.col("total_cost")).alias("d"), F.size("lines").alias("n"))
    assert j.filter(F.col("d") > F.col("n") * F.lit(D("0.005"))).count() == 0


def _fold(events):
    out = {}
    for c, seq, kind, amt, ts in sorted(events, key=lambda e: (e[0], e[1])):
        n, tot, last = out.get(c, (0, D(0), None))
        a = amt or D(0)
        if kind == "delete":
            n, tot = max(0, n - 1), max(D(0), tot - a)
        else:
            n, tot, last = n + 1, tot + a, ts
        out[c] = (n, tot, last)
    return out


def test_ledger_closed_form_equals_fold_across_buckets(spark):
    rnd = random.Random(7)
    events, seq = [], 0
    for _ in range(600):
        seq += rnd.randint(1, 3)
        c = "hot" if rnd.random() < 0.4 else f"c{rnd.randint(0, 9)}"
        kind = "delete" if rnd.random() < 0.35 else "add"
        amt = None if rnd.random() < 0.05 else D(rnd.randint(-300, 3000)) / 100
        events.append((c, seq, kind, amt, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq)))
    df = spark.createDataFrame(events, "customer_id string, seq long, kind string, amount decimal(12,2), "
                                       "ts timestamp")
    want = _fold(events)
    for bucket in (7, 64, 1 << 16):
        got = {r.customer_id: (r.total_orders, r.total_spent, r.last_order_at)
               for r in CU.customer_ledger(df, bucket_size=bucket).collect()}
        assert got == {k: (n, t.quantize(D("0.01")), last) for k, (n, t, last) in want.items()}, bucket


def _replay(base, changes, cols):
    rows = {k: dict(v) for k, v in base.items()}
    for ch in sorted(changes, key=lambda c: c["seq"]):
        k, op = ch["k"], ch["op"]
        if op == "delete":
            rows.pop(k, None)
        elif op == "insert":
            rows[k] = {c: (ch[c] if ch[c + "__set"] else None) for c in cols}
            rows[k]["updated_at"] = ch["changed_at"]
        elif k in rows:
            for c in cols:
                if ch[c + "__set"]:
                    rows[k][c] = ch[c]
            rows[k]["updated_at"] = ch["changed_at"]
    return rows


def test_apply_changes_equals_sequential_replay(spark):
    rnd = random.Random(11)
    cols = ["a", "b"]
    base = {k: {"a": f"a{k}", "b": k * 10, "updated_at": None} for k in range(0, 12)}
    changes = []
    for seq in range(400):
        ch = {"k": rnd.randint(0, 19), "seq": seq, "op": rnd.choice(["insert", "update", "update", "delete"]),
              "changed_at": dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq)}
        for c in cols:
            ch[c + "__set"] = rnd.random() < 0.6
            ch[c] = None if rnd.random() < 0.2 else (f"v{seq}" if c == "a" else seq)
        changes.append(ch)
    want = _replay(base, changes, cols)
    bdf = spark.createDataFrame([(k, v["a"], v["b"], v["updated_at"]) for k, v in base.items()],
                                "k long, a string, b long, updated_at timestamp")
    cdf = spark.createDataFrame([(c["k"], c["seq"], c["op"], c["changed_at"], c["a"], c["a__set"], c["b"],
                                  c["b__set"]) for c in changes],
                                "k long, seq long, op string, changed_at timestamp, a string, a__set boolean, "
                                "b long, b__set boolean")
    got = {r.k: {"a": r.a, "b": r.b, "updated_at": r.updated_at}
           for r in CH.apply_changes(bdf, cdf, "k", cols).collect()}
    assert got == want


def test_number_orders_equals_global_row_number(spark):
    from pyspark.sql import Window
    _, _, valid, _, _ = _priced(spark)
    numbered = O.number_orders(valid, num_partitions=5)
    ref = valid.select("request_id", F.row_number().over(Window.orderBy("created_at", "request_id")).alias("k"))
    j = numbered.join(ref, "request_id")
    assert j.filter(F.col("order_seq") != F.col("k")).count() == 0
    assert numbered.select("order_number").distinct().count() == valid.count()


def test_cascade_and_restrict(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "fk long, v string")
    dead = spark.createDataFrame([(1,), (3,)], "k long")
    assert sorted(r.v for r in CH.cascade_delete(child, dead, "fk").collect()) == ["c", "d"]
    assert [(r.fk, r.blocking_rows) for r in CH.restrict_check(child, dead, "fk").collect()] == [(1, 2)]


def test_ledger_chunks_follow_positions_not_seq_values(spark):
    n, size = 20_000, 1_000
    ev = spark.range(n).select(F.lit(1).alias("customer_id"), (F.col("id") * 1_000_003).alias("seq"),
                               F.lit("add").alias("kind"), F.lit(1).cast("decimal(12,2)").alias("amount"),
                               F.lit(dt.datetime(2024, 1, 1)).alias("ts"))
    chunks = CU.ledger_chunks(ev, bucket_size=size)
    assert chunks.count() <= n // size + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = CU.customer_ledger(ev, bucket_size=size).first()
    assert (got.total_orders, got.total_spent) == (n, n)
