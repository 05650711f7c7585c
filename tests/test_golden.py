"""Golden values computed by hand from the kitchen's sample data."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from larder.operators import catalog as C
from larder.operators import orders as O
from larder.operators import reports as R
from tests.seed import REQUEST_SCHEMA, request


def test_sample_has_102_lines(kitchen):
    assert kitchen.lines.count() == 102


def test_recipe_costing_golden(kitchen):
    k = kitchen
    rows = {r.recipe_id: r for r in
            C.recipe_costing(k.recipes, k.types, k.sizes, k.lines, k.ingredients).collect()}
    expect = {"r1": (6100, 8000, 1900, "23.75"), "r2": (8710, 12000, 3290, "27.42"), "r3": (8710, None, None, None),
              "r4": (13300, 13000, -300, "-2.31"), "r5": (20310, 18000, -2310, "-12.83"),
              "r6": (20310, None, None, None), "r7": (21100, 15000, -6100, "-40.67"),
              "r8": (31210, 22000, -9210, "-41.86"), "r9": (31210, None, None, None)}
    assert set(rows) == set(expect)
    for rid, (total, price, profit, margin) in expect.items():
        r = rows[rid]
        assert r.total_cost == D(total), rid
        assert r.base_selling_price == (None if price is None else D(price))
        assert r.profit == (None if profit is None else D(profit))
        assert r.profit_margin_pct == (None if margin is None else D(margin))


def _price(spark, kitchen, reqs):
    k = kitchen
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    valid, rejected = O.validate_orders(spark.createDataFrame(reqs, REQUEST_SCHEMA), k.sizes, dim)
    return O.price_orders(valid), rejected


def test_price_orders_golden(spark, kitchen):
    reqs = [request("A", 1, "t1", "s1", ["i7"]), request("B", 2, "t2", "s1", [], ["i14"]),
            request("C", 3, "t1", "s1", ["i8"]), request("D", 4, "t1", "s3"),
            request("E", 5, "t2", "s1", ["nope"], ["i14", "i14"]), request("F", 6, "t1", "s1", None, None),
            request("G", 7, "t2", "s1", [], None)]
    priced, rejected = _price(spark, kitchen, reqs)
    got = {r.order_id: r for r in priced.collect()}
    expect = {"A": (5500, 8000, 2500, False), "B": (16300, 16000, -300, False), "C": (6100, 8000, 1900, False),
              "D": (8710, None, None, True), "E": (16300, 16000, -300, False), "F": (6100, 8000, 1900, False)}
    assert set(got) == set(expect)
    for oid, (sub, price, profit, pending) in expect.items():
        r = got[oid]
        assert (r.subtotal_cost, r.selling_price, r.profit, r.needs_price_confirmation) == (
            D(sub), None if price is None else D(price), None if profit is None else D(profit), pending), oid
    assert [(r.request_id, r.reject_reason) for r in rejected.collect()] == [("G", "null_selection")]


def test_needs_and_stats_over_a_and_b(spark, kitchen):
    priced, _ = _price(spark, kitchen, [request("A", 1, "t1", "s1", ["i7"]),
                                        request("B", 2, "t2", "s1", [], ["i14"])])
    lines = O.order_lines(priced)
    for cancel_b in (False, True):
        orders = priced.select(F.col("order_id").alias("id"), "pickup_date", "created_at",
                               F.when(F.lit(cancel_b) & (F.col("order_id") == "B"), "ملغي").otherwise("جديد")
                               .alias("status"))
        needs = {r.ingredient_id: r.total_quantity for r in
                 R.ingredient_needs(lines, orders, kitchen.ingredients, "2024-01-01", "2024-01-31").collect()}
        stats = {r.ingredient_name: (r.included_count, r.excluded_count) for r in
                 R.selection_stats(lines, orders, "2024-01-01", "2024-01-31").collect()}
        if not cancel_b:
            assert needs["i1"] == D("1.000") and needs["i7"] == D("0.300") and needs["i14"] == D("0.250")
        else:
            assert needs["i1"] == D("0.500") and "i14" not in needs and "i7" not in needs
        # Cancelled orders still count in the selection statistics.
        assert stats["onion"] == (2, 0) and stats["broad beans"] == (1, 1) and stats["extra meat"] == (1, 0)


def test_recipe_menu_hides_costs_and_orders_lines(kitchen):
    k = kitchen
    menu = C.recipe_menu(k.recipes, k.sizes, k.lines, k.ingredients)
    row = menu.filter("recipe_id = 'r4'").first()
    assert [line.display_order for line in row.ingredients] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 21, 22]
    assert "unit_price" not in row.ingredients[0].asDict()
    assert row.ingredients[-1].default_included is False
    assert menu.filter("recipe_id = 'r3'").first().base_selling_price is None
    assert menu.count() == 9


def test_menu_sections_and_allergen_warning(kitchen):
    k = kitchen
    sec = C.menu_sections(C.recipe_menu(k.recipes, k.sizes, k.lines, k.ingredients)).filter("recipe_id = 'r4'")
    by = {r.ingredient_id: r for r in sec.collect()}
    assert by["i1"].is_toggleable and not by["i1"].is_fixed
    assert by["i8"].is_fixed and not by["i8"].is_toggleable
    assert by["i14"].is_optional_addon and not by["i14"].is_fixed_addon
    assert by["i11"].is_fixed_addon
    assert all(r.has_allergen_warning for r in by.values())  # broad beans are toggleable


def test_scale_recipes_keeps_unscaled(kitchen):
    q = {(r.recipe_id, r.ingredient_id): r.quantity for r in kitchen.lines.collect()}
    assert q[("r2", "i1")] == D("0.800") and q[("r2", "i3")] == D("0.480") and q[("r2", "i10")] == D("1.000")
    assert q[("r1", "i9")] == D("0.100") and q[("r5", "i9")] == D("0.160")


def test_unused_ingredients(spark, kitchen):
    k = kitchen
    got = sorted(r.ingredient_id for r in C.unused_ingredients("r1", k.ingredients, k.lines).collect())
    assert got == ["i11", "i12", "i13", "i14"]
    assert sorted(r.ingredient_id for r in C.unused_ingredients("r4", k.ingredients, k.lines).collect()) == ["i13"]


def test_number_orders_format(spark, kitchen):
    reqs = [request(f"o{i}", i, "t1", "s1", created=dt.datetime(2024, 3, 1) + dt.timedelta(minutes=i))
            for i in range(5)]
    valid, _ = O.validate_orders(spark.createDataFrame(reqs, REQUEST_SCHEMA), kitchen.sizes,
                                 O.recipe_dimension(kitchen.recipes, kitchen.lines, kitchen.ingredients))
    got = sorted((r.request_id, r.order_number) for r in O.number_orders(valid, start=9998).collect())
    assert got == [("o0", "DLM-20240301-9998"), ("o1", "DLM-20240301-9999"), ("o2", "DLM-20240301-10000"),
                   ("o3", "DLM-20240301-10001"), ("o4", "DLM-20240301-10002")]


def test_create_orders_places_numbers_and_updates_customers(spark, kitchen):
    from larder.operators.placement import create_orders
    from larder.schemas import CUSTOMERS
    from tests.seed import T0
    k = kitchen
    customers = spark.createDataFrame([("c1", "Old name", "07700000001", "home", 3, D("100.00"), T0, T0)], CUSTOMERS)
    reqs = spark.createDataFrame(
        [request("A", 1, "t1", "s1", ["i7"], name=" Sara "), request("B", 2, "t2", "s1", [], ["i14"], address="new"),
         request("X", 3, "t1", "s3", phone="07900000009", name="Ali"), request("G", 4, "t2", "s1", [], None)],
        REQUEST_SCHEMA)
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    placed = create_orders(reqs, k.sizes, dim, customers, start_number=41)
    orders = {r.order_id: r for r in placed.orders.collect()}
    assert sorted(orders) == ["A", "B", "X"]
    assert [orders[o].order_number[-4:] for o in ("A", "B", "X")] == ["0041", "0042", "0043"]
    assert orders["A"].customer_id == orders["B"].customer_id == "c1"
    assert orders["A"].status == "جديد" and orders["X"].selling_price is None
    cust = {r.phone: r for r in placed.customers.collect()}
    c1 = cust["07700000001"]
    assert (c1.name, c1.address, c1.total_orders, c1.total_spent) == ("Sara", "new", 5, D("24100.00"))
    assert cust["07900000009"].total_orders == 1 and cust["07900000009"].total_spent == D("0.00")
    assert [r.request_id for r in placed.rejected.collect()] == ["G"]
    assert placed.lines.filter("order_id = 'A'").count() == 10
    told = placed.confirmation
    assert not {"subtotal_cost", "profit", "cost_snapshot"} & set(told.columns)
    assert told.filter("order_id = 'A'").count() == 10


def test_stored_orders_round_trip_through_the_sink(spark, kitchen, tmp_path):
    from larder.operators.placement import create_orders
    from larder.schemas import CUSTOMERS, ORDERS
    from larder.sources import read_table, write_orders
    k = kitchen
    reqs = spark.createDataFrame([request("A", 1, "t1", "s1", ["i7"]), request("B", 2, "t2", "s1", [], ["i14"])], REQUEST_SCHEMA)
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    placed = create_orders(reqs, k.sizes, dim, spark.createDataFrame([], CUSTOMERS))
    assert [(f.name, f.dataType) for f in placed.stored.schema] == [(f.name, f.dataType) for f in ORDERS]
    write_orders(placed.stored, f"{tmp_path}/orders.parquet")
    back = read_table(spark, str(tmp_path), "orders").select(placed.stored.columns)
    assert sorted(back.collect()) == sorted(placed.stored.collect())
    assert back.filter("customer_id is null or order_number is null").count() == 0
