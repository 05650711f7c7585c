"""Reports from daily rollups equal the direct ones; a changed day replaces only itself."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from larder.operators import reports as R
from larder.operators import rollups as RU

SCHEMA = "id int, product_type_id string, size_id string, status string, selling_price decimal(12,2), profit decimal(12,2), created_at timestamp"


def _orders(spark, n=400, kind="timestamp", seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["t1", "t2", None, "t9"]), rng.choice(["s1", "s2", None]), rng.choice(["new", "done", "gone", None]),
             rng.choice([None, D("9999999999.99"), D(rng.randrange(5000)) / 100]), rng.choice([None, D("-1.50"), D("2.25")]),
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 40))) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("created_at", F.col("created_at").cast(kind))


def _dims(spark):
    return (spark.createDataFrame([("t1", "one"), ("t2", "")], "id string, name string"),
            spark.createDataFrame([("s1", "big"), ("s2", None)], "id string, name string"))


def _same(a, b):
    assert sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


@pytest.mark.parametrize("kind,tz", [("timestamp", None), ("timestamp", "Asia/Baghdad"), ("timestamp_ntz", "Asia/Baghdad")])
def test_reports_from_the_rollup(spark, tmp_path, kind, tz):
    orders, (types, sizes) = _orders(spark, kind=kind), _dims(spark)
    RU.write_rollup(RU.daily_rollup(orders, tz), str(tmp_path / "r"), 0)
    rollup = RU.read_rollup(spark, str(tmp_path / "r"))
    money = ["sales", "profit"]
    for d1, d2 in (("2024-01-05", "2024-01-20"), ("2024-01-08", "2024-01-08"), ("2030-01-01", "2030-01-02")):
        got, want = RU.sales_between(rollup, d1, d2, "gone").first(), R.sales_between(orders, d1, d2, "gone", tz).first()
        assert got["order_count"] == want["order_count"] and [D(got[m]) for m in money] == [D(want[m]) for m in money]
        _same(RU.sales_ranking(rollup, types, sizes, d1, d2, "gone"), R.sales_ranking(orders, types, sizes, d1, d2, "gone", tz))
    got, want = (x.first().asDict() for x in (RU.trailing_sales(rollup, "2024-02-03", "gone"), R.trailing_sales(orders, "2024-02-03", "gone", tz)))
    assert {k: D(v) for k, v in got.items()} == {k: D(v) for k, v in want.items()}


def test_a_changed_status_replaces_only_its_days(spark, tmp_path):
    path, orders = str(tmp_path / "r"), _orders(spark)
    RU.write_rollup(RU.daily_rollup(orders), path, 0)

    def files():
        return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before, day = files(), dt.date(2024, 1, 9)
    changed = orders.withColumn("status", F.when(F.to_date("created_at") == F.lit(day), "gone").otherwise(F.col("status")))
    for _ in range(2):  # the second time changes nothing
        RU.refresh_rollup(changed, path, 1, [day])
        assert before == {f: t for f, t in files().items() if "version=0" in f}
        assert {r["created_date"] for r in spark.read.parquet(f"{path}/version=1").collect()} == {day}
        _same(RU.read_rollup(spark, path).select(*RU.KEYS, *RU.MEASURES), RU.daily_rollup(changed).select(*RU.KEYS, *RU.MEASURES))
    # A day whose orders are all deleted.
    left = changed.where(F.to_date("created_at") != F.lit(day))
    RU.refresh_rollup(left, path, 2, [day, "2024-01-10"])
    RU.refresh_rollup(left, path, 3, [])
    _same(RU.read_rollup(spark, path).select(*RU.KEYS, *RU.MEASURES), RU.daily_rollup(left).select(*RU.KEYS, *RU.MEASURES))


def test_a_refresh_reads_only_the_folders_of_its_days(spark, tmp_path):
    from larder.sources import write_orders
    write_orders(_orders(spark), str(tmp_path / "o"))
    facts = spark.read.parquet(str(tmp_path / "o"))
    RU.write_rollup(RU.daily_rollup(facts.drop("created_date")), str(tmp_path / "r"), 0)
    RU.refresh_rollup(facts, str(tmp_path / "r"), 1, ["2024-01-03"])
    _same(RU.read_rollup(spark, str(tmp_path / "r")).select(*RU.KEYS, *RU.MEASURES), RU.daily_rollup(facts).select(*RU.KEYS, *RU.MEASURES))


def test_an_empty_table_has_an_empty_rollup(spark):
    assert RU.daily_rollup(_orders(spark).limit(0)).count() == 0
