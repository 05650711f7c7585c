"""Plan shape checks: broadcast pricing without an order shuffle, pushdown,
no Python in the plans, and the driver contract."""

import re

from larder.operators import orders as O
from larder.plans import bindings as b
from larder.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pricing_broadcasts_recipes_and_does_not_shuffle_orders(spark, kitchen, tmp_path):
    from tests.seed import REQUEST_SCHEMA, request

    def stored(name):  # Spark knows the bytes of stored tables only
        getattr(kitchen, name).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")
    lines = stored("lines")
    reqs = spark.createDataFrame([request("A", 1, "t1", "s1", ["i7"])], REQUEST_SCHEMA)
    dim = O.broadcast_recipe_dimension(O.recipe_dimension(stored("recipes"), lines, stored("ingredients")), lines)
    valid, _ = O.validate_orders(reqs, stored("sizes"), dim)
    priced_plan = _plan(O.price_orders(valid))
    dim_plan = _plan(dim)
    assert "BroadcastHashJoin" in priced_plan
    shuffles = lambda p: len(re.findall(r"Exchange hashpartitioning", p))
    # Every hash exchange in the pricing plan is inside the recipe dimension's build side.
    assert shuffles(priced_plan) == shuffles(dim_plan)


def test_no_python_in_registered_plans(spark):
    for name, q in REGISTRY.items():
        if name == "number_orders":
            continue  # checkpoints eagerly; covered by its own tests
        plan = _plan(q(spark, SF))
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_date_range_is_pushed_to_the_scan(spark):
    from larder.operators.reports import sales_between
    t = b.Tables(spark, SF)
    plan = sales_between(b.orders(t), "1996-01-01", "1996-12-31", cancelled="P")._jdf.queryExecution() \
        .executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)


def test_column_pruning_in_costing(spark):
    from larder.operators.catalog import recipe_costing
    t = b.Tables(spark, SF)
    plan = _plan(recipe_costing(b.recipes(t), b.product_types(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t)))
    for schema in re.findall(r"ReadSchema: (struct<[^>]*>)", plan):
        assert "p_brand" not in schema and "p_name" not in schema


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
