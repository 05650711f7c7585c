"""Ops 1-2: typed reads and fact sinks."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

import pytest
from larder.plans.testdata import TESTDATA
from larder.schemas import DOMAIN
from larder.sources import load_tables, read_table, write_load, write_order_lines, write_orders
from larder.sources.sinks import write_batch

SF = "/root/testdata/sf0.001"


def test_typed_reads_use_the_declared_schema(spark):
    tables = load_tables(spark, SF, ["orders", "part"], columns={"part": ["p_partkey", "p_size"]}, schemas=TESTDATA)
    assert tables["orders"].schema == TESTDATA["orders"]
    assert tables["part"].columns == ["p_partkey", "p_size"]
    plan = tables["part"].filter(F.col("p_size") > 10)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    assert read_table(spark, SF, "region", schemas=TESTDATA).count() == 5


def test_fact_sinks_partition_by_created_day(spark, tmp_path):
    orders = spark.createDataFrame(
        [("a", D("10.00"), dt.datetime(2024, 1, 1, 9), [1]), ("b", D("20.00"), dt.datetime(2024, 1, 2, 9), [2])],
        "order_id string, selling_price decimal(12,2), created_at timestamp, lines array<int>")
    out = str(tmp_path / "orders")
    write_orders(orders, out)
    write_orders(orders.filter("order_id = 'a'"), out)  # append
    back = spark.read.parquet(out)
    assert "lines" not in back.columns
    assert sorted((r.created_date, r.n) for r in back.groupBy("created_date").agg(F.count("*").alias("n")).collect()) \
        == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 2), 1)]
    lines = spark.createDataFrame([("a", "i1", dt.datetime(2024, 1, 1, 9))],
                                  "order_id string, ingredient_id string, created_at timestamp")
    write_order_lines(lines, str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).count() == 1


def test_batch_writes_are_idempotent(spark, tmp_path):
    df = spark.range(5)
    out = str(tmp_path / "b")
    write_batch(df, out, 3)
    write_batch(df, out, 3)  # a retried micro-batch replaces its own output
    write_batch(df.limit(2), out, 4)
    got = {r.batch_id: r.n for r in spark.read.parquet(out).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert got == {3: 5, 4: 2}


def test_each_domain_table_round_trips(spark, tmp_path):
    for name, schema in DOMAIN.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
        assert read_table(spark, str(tmp_path), name).schema == schema
    spark.createDataFrame([("o1",)], "id string").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert read_table(spark, str(tmp_path), "orders", ["id"]).first()["id"] == "o1"


def test_reports_prune_written_days(spark, tmp_path):
    from larder.operators.reports import sales_between
    rows = [(f"o{k}", f"2024-01-{k + 1:02d} 12:00:00", 99_999_999.99) for k in range(9)]
    orders = spark.createDataFrame(rows, "id string, created_at string, selling_price double").selectExpr(
        "id", "cast(created_at as timestamp) as created_at", "cast(selling_price as decimal(12,2)) as selling_price",
        "cast(0 as decimal(12,2)) as profit", "'x' as status")
    write_orders(orders.unionAll(orders.limit(0)), f"{tmp_path}/facts")
    report = sales_between(spark.read.parquet(f"{tmp_path}/facts"), "2024-01-03", "2024-01-04")
    assert "PartitionFilters: [isnotnull(created_date" in report._jdf.queryExecution().toString()
    assert report.first()["order_count"] == 2
    # More than the 12 digits of one order's column.
    many = orders.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200))))
    assert float(sales_between(many, "2024-01-01", "2024-01-31").first()["sales"]) == pytest.approx(99_999_999.99 * 1800)


def test_kitchen_audit_counts_each_kind_of_violation(spark):
    from larder.operators.quality import kitchen_audit
    sizes = spark.createDataFrame([("s1", "one", "fixed"), ("s2", None, "free")], "id string, name string, pricing_mode string")
    recipes = spark.createDataFrame(
        [("r1", "s1", "a", None), ("r2", "s1", "b", D("1.00")), ("r3", "s9", "c", D("1.00"))],
        "id string, size_id string, name string, base_selling_price decimal(12,2)")
    customers = spark.createDataFrame([("c1", "07"), ("c2", "07"), ("c3", "07")], "id string, phone string")
    got = {r.rule: r.violations for r in kitchen_audit(
        {"sizes": sizes, "recipes": recipes, "customers": customers}).collect() if r.violations}
    assert got == {"sizes.name not null": 1, "sizes.pricing_mode allowed": 1, "customers.phone unique": 2,
                   "recipes.size_id references sizes": 1, "recipes.base_selling_price null only for custom sizes": 1}
    empty = kitchen_audit({"customers": customers.limit(0)}).collect()
    assert empty and not any(r.violations for r in empty)


def _facts(spark, load):
    """(orders, lines) of a load over three days."""
    rows = [(f"{load}{k}", D(k), dt.datetime(2024, 1, 1 + k % 3, 9)) for k in range(9)]
    orders = spark.createDataFrame(rows, "id string, selling_price decimal(12,2), created_at timestamp")
    lines = orders.select(F.col("id").alias("order_id"), F.explode(F.array(F.lit("i1"), F.lit("i2"))).alias("ingredient_id"), "created_at")
    return orders, lines


def test_a_load_written_again_is_read_once(spark, tmp_path):
    out = [str(tmp_path / x) for x in ("orders", "lines")]
    for load in ("a", "b", "a"):
        for facts, path in zip(_facts(spark, load), out):
            write_load(facts, path, load)
    for path, key, n in ((out[0], "id", 18), (out[1], "order_id", 36)):
        back = spark.read.parquet(path)
        assert back.count() == n and back.select(key, *[c for c in ("ingredient_id",) if c in back.columns]).distinct().count() == n
    assert sorted({(r["created_date"].day, r["load_id"]) for r in spark.read.parquet(out[0]).collect()}) == [(d, x) for d in (1, 2, 3) for x in "ab"]


def test_a_load_that_dies_halfway_leaves_nothing_and_is_run_again(spark, tmp_path):
    path = str(tmp_path / "orders")
    write_load(_facts(spark, "a")[0], path, "a")
    bad = _facts(spark, "b")[0].repartition(5).withColumn(
        "selling_price", F.when(F.col("id") == "b7", F.raise_error(F.lit("killed")).cast("decimal(12,2)")).otherwise(F.col("selling_price")))
    with pytest.raises(Exception, match="killed"):
        write_load(bad, path, "b")
    assert {r["load_id"] for r in spark.read.parquet(path).collect()} == {"a"}
    for _ in range(2):
        write_load(_facts(spark, "b")[0], path, "b")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [f"{x}{k}" for x in "ab" for k in range(9)]


def test_co_located_facts_join_without_moving_lines(spark, kitchen, tmp_path):
    from larder.operators import reports as R
    from larder.operators.lists import order_detail
    from larder.sources import save_co_located
    orders, lines = _facts(spark, "a")
    orders = orders.withColumn("status", F.lit("new")).withColumn("pickup_date", F.to_date("created_at"))
    lines = (lines.withColumn("is_included", F.col("ingredient_id") == "i1").withColumn("quantity_snapshot", F.lit(2).cast("decimal(12,3)"))
             .withColumn("ingredient_name_snapshot", F.concat(F.lit("name "), "ingredient_id")).withColumn("is_allergen", F.lit(False))
             .withColumn("price_delta_applied", F.lit(0).cast("decimal(12,2)")))
    names = [f"facts_{tmp_path.name}_{x}".replace("-", "_") for x in ("orders", "lines")]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        save_co_located(orders, lines, *names, buckets=4)
        o, l = (spark.table(n) for n in names)
        reports = {
            "needs": lambda o, l: R.ingredient_needs(l, o, kitchen.ingredients, "2024-01-01", "2024-01-02"),
            "stats": lambda o, l: R.selection_stats(l, o, "2024-01-01", "2024-01-02"),
            "detail": lambda o, l: order_detail(l, o.where("selling_price < 5").select("id"))}
        for name, fn in reports.items():
            got = fn(o, l)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fn(orders, lines).collect())), name
            plan = got._jdf.queryExecution().executedPlan().toString()
            join = plan.index("SortMergeJoin")
            # All exchanges by order id are above no scan of the facts: below the join there are none.
            assert "hashpartitioning(order_id" not in plan[join:] and "Bucketed: true" in plan, name
        # Without buckets the lines are exchanged.
        assert "hashpartitioning(order_id" in reports["stats"](orders, lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_selection_stats_prune_lines(spark, tmp_path):
    from larder.operators.reports import selection_stats
    orders, lines = _facts(spark, "a")
    lines = lines.withColumn("is_included", F.lit(True)).withColumn("ingredient_name_snapshot", F.col("ingredient_id"))
    write_orders(orders, str(tmp_path / "o"))
    write_order_lines(lines, str(tmp_path / "l"))
    o, l = spark.read.parquet(str(tmp_path / "o")), spark.read.parquet(str(tmp_path / "l"))
    got = selection_stats(l, o, "2024-01-02", "2024-01-02")
    assert got._jdf.queryExecution().toString().count("PartitionFilters: [isnotnull(created_date") >= 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, selection_stats(lines.drop("created_at"), orders, "2024-01-02", "2024-01-02").collect()))
