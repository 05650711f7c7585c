"""The joins past Spark's broadcast threshold give the same results."""

from pyspark.sql import functions as F

from larder.operators import orders as O
from larder.plans import bindings as b
from larder.plans.q_orders import recipe_dim
from larder.plans.q_streams import _stream_dim
from larder.plans.queries import REGISTRY
from larder.streaming.orders import _checked

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pricing_over_the_threshold_plans_a_shuffle_join_with_equal_results(spark, monkeypatch):
    small = _rows(REGISTRY["price_orders"](spark, SF))
    monkeypatch.setattr(O, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = REGISTRY["price_orders"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        big = _rows(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan, plan
    assert small == big


def test_hot_recipe_same_on_broadcast_and_shuffle_paths(spark, monkeypatch):
    """A third of all requests on one recipe; the shuffle-join path (where AQE
    splits the hot partition) prices exactly like the broadcast path."""
    t = b.Tables(spark, SF)
    reqs = b.requests(t)
    hot = reqs.filter(F.col("request_id") % 3 == 0) \
        .withColumn("product_type_id", F.lit(1).cast("long")).withColumn("size_id", F.lit(1).cast("long"))
    skewed = reqs.filter(F.col("request_id") % 3 != 0).unionByName(hot)

    def price():
        dim = O.recipe_dimension(b.recipes(t), b.recipe_lines(t), b.ingredients(t))
        valid, _ = O.validate_orders(skewed, b.sizes(t), O.broadcast_recipe_dimension(dim, b.recipe_lines(t)))
        return _rows(O.price_orders(valid).select("order_id", "subtotal_cost", "selling_price", "profit"))

    broadcast_path = price()
    monkeypatch.setattr(O, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffle_path = price()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert broadcast_path == shuffle_path and len(broadcast_path) > 0


def test_a_batch_of_one_file_is_read_in_shares(spark):
    """Rows that carry their recipe's lines are many times as wide as they came; no task keeps a whole file's."""
    t = b.Tables(spark, SF)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "4k")
    try:
        checked = _checked(b.requests(t).coalesce(1), b.sizes(t), recipe_dim(t)).persist()
        per_task = [r["count"] for r in checked.groupBy(F.spark_partition_id()).count().collect()]
        checked.unpersist()
    finally:
        spark.conf.unset(key)
    assert len(per_task) > 1 and max(per_task) < sum(per_task) / 2
    assert sum(per_task) == b.requests(t).count()


def test_a_stream_broadcasts_only_what_every_batch_may_send_again(spark, monkeypatch):
    t = b.Tables(spark, SF)
    size = int(str(b.recipe_lines(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def hinted(dim):
        return "broadcast" in dim._jdf.queryExecution().analyzed().toString()

    monkeypatch.setattr(O, "BROADCAST_BYTES", size)
    assert hinted(recipe_dim(t)) and not hinted(_stream_dim(t))
    monkeypatch.setattr(O, "BROADCAST_BYTES", 17 * size)
    assert hinted(_stream_dim(t))
