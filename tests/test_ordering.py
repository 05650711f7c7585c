"""Row order of the sorted lists (the oracle's hash is order-free), and the
phone rule against a plain statement of it."""

import datetime as dt
import re
from decimal import Decimal as D

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.functions.phones import standard_phone
from larder.operators import catalog as C
from larder.operators import lists as L


def test_recipe_catalog_and_price_list_order(kitchen):
    k = kitchen
    rows = C.recipe_catalog(k.recipes, k.types, k.sizes).collect()
    assert [r.id for r in rows] == [f"r{i}" for i in range(1, 10)]
    assert rows[0].product_type_name == "regular pot" and rows[2].size_name == "size 3"
    prices = C.price_list(C.recipe_costing(k.recipes, k.types, k.sizes, k.lines, k.ingredients)).collect()
    assert [r.product_type_name for r in prices] == sorted(r.product_type_name for r in prices)


def test_active_catalog_admin_sees_all(spark):
    df = spark.createDataFrame([("b", 2, True), ("a", 1, False), ("c", 1, True)],
                               "id string, display_order int, is_active boolean")
    assert [r.id for r in C.active_catalog(df, ["display_order"]).collect()] == ["c", "b"]
    assert [r.id for r in C.active_catalog(df, ["display_order"], is_admin=True).collect()] == ["a", "c", "b"]


def test_history_newest_first_and_detail_by_name(spark):
    orders = spark.createDataFrame(
        [("o1", "c1", dt.datetime(2024, 1, 1)), ("o2", "c1", dt.datetime(2024, 3, 1)),
         ("o3", "c2", dt.datetime(2024, 2, 1)), ("o4", "c9", dt.datetime(2024, 4, 1))],
        "id string, customer_id string, created_at timestamp")
    ids = spark.createDataFrame([("c1",), ("c2",)], "id string")
    assert [r.id for r in L.customer_history(orders, ids).collect()] == ["o2", "o1", "o3"]
    lines = spark.createDataFrame(
        [("o1", "i2", "tomato", True, False, D("0.00")), ("o1", "i1", "beans", False, True, D("-500.00")),
         ("o2", "i3", "rice", True, False, D("0.00"))],
        "order_id string, ingredient_id string, ingredient_name_snapshot string, is_included boolean, "
        "is_allergen boolean, price_delta_applied decimal(12,2)")
    got = [(r.ingredient_name_snapshot, r.delta_shown) for r in
           L.order_detail(lines, spark.createDataFrame([("o1",)], "id string")).collect()]
    assert got == [("beans", True), ("tomato", False)]


def _rule(raw: str) -> str:
    """The sign-in phone rule, stated in plain Python."""
    d = re.sub(r"[\s-]", "", raw)
    if d.startswith("+"):
        return d
    if d.startswith("00"):
        return "+" + d[2:]
    if d.startswith("0"):
        return "+964" + d[1:]
    return "+964" + d


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-   \t", max_size=16), min_size=1, max_size=20))
def test_standard_phone_matches_the_rule(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws], "phone string")
    got = [r.p for r in df.select(standard_phone("phone").alias("p")).collect()]
    assert got == [_rule(r) for r in raws]
