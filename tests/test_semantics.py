"""One test per semantic trap of the data model."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from larder.functions.money import margin_pct
from larder.functions.phones import standard_phone
from larder.operators import catalog as C
from larder.operators import customers as CU
from larder.operators import lists as L
from larder.operators import orders as O
from larder.operators import reports as R
from larder.schemas import INGREDIENTS, RECIPE_LINES, RECIPES, SIZES
from tests.seed import REQUEST_SCHEMA, T0, request


def _tiny(spark, lines, base_price="8000", mode="fixed", visible=True):
    """One recipe r (type t, size s) with the given (ingredient, qty, price, optional, rule, delta, addon) lines."""
    ing = spark.createDataFrame(
        [(i, f"n{i}", "kg", D(p), "quantity", D(0), True, visible, True, False, False, None, T0, T0)
         for i, _, p, *_ in lines], INGREDIENTS)
    rl = spark.createDataFrame(
        [(f"r:{i}", "r", i, D(q), opt, rule, D(delta), addon, n, T0)
         for n, (i, q, _, opt, rule, delta, addon) in enumerate(lines)], RECIPE_LINES)
    rec = spark.createDataFrame([("r", "t", "s", "r", D(0), D(0), None if base_price is None else D(base_price),
                                  True, T0, T0)], RECIPES)
    sizes = spark.createDataFrame([("s", "s", "s", None, mode, 1, True, T0)], SIZES)
    types = spark.createDataFrame([("t", "t", "t", None, 1, False, T0)], "id string, key string, name string, "
                                  "description string, display_order int, is_active boolean, created_at timestamp")
    return ing, rl, rec, sizes, types


def _priced(spark, tiny, reqs):
    ing, rl, rec, sizes, _ = tiny
    valid, rejected = O.validate_orders(spark.createDataFrame(reqs, REQUEST_SCHEMA), sizes,
                                        O.recipe_dimension(rec, rl, ing))
    return O.price_orders(valid), rejected


def test_line_rounded_per_order_but_not_in_costing(spark):
    tiny = _tiny(spark, [("a", "0.333", "1000.55", False, "included_fixed", 0, False)])
    priced, _ = _priced(spark, tiny, [request("x", 1, "t", "s")])
    assert priced.first().subtotal_cost == D("333.18")
    ing, rl, rec, sizes, types = tiny
    cost = C.recipe_costing(rec, types, sizes, rl, ing).first()
    assert cost.total_cost == D("333.18315")


def test_margin_rounds_once():
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    v = s.range(1).select(margin_pct(F.lit(D("12344.99999")).cast("decimal(36,5)"),
                                     F.lit(D("100000")).cast("decimal(12,2)")).alias("m")).first().m
    assert v == D("12.34")


def test_null_inside_extras_rejects_optional_addon(spark):
    tiny = _tiny(spark, [("a", "1", "10", True, "extra_cost_addon", 5, True)])
    _, rejected = _priced(spark, tiny, [request("x", 1, "t", "s", [], [None])])
    assert rejected.first().reject_reason == "null_selection"
    # A NULL extras array on a recipe whose add-on is not optional is fine.
    tiny2 = _tiny(spark, [("a", "1", "10", False, "extra_cost_addon", 5, True)])
    priced, rejected = _priced(spark, tiny2, [request("x", 1, "t", "s", [], None)])
    assert priced.count() == 1 and rejected.count() == 0


def test_reduce_on_remove_and_no_floor(spark):
    tiny = _tiny(spark, [("a", "1", "10", True, "included_reduce_on_remove", 500, False)], base_price="300")
    priced, _ = _priced(spark, tiny, [request("x", 1, "t", "s", ["a"])])
    r = priced.first()
    assert r.selling_price == D("-200.00")  # no floor at 0
    assert r.subtotal_cost == D("0.00")


def test_fixed_price_null_counts_as_zero_but_costing_profit_null(spark):
    tiny = _tiny(spark, [("a", "1", "10", False, "included_fixed", 0, False)], base_price=None)
    priced, _ = _priced(spark, tiny, [request("x", 1, "t", "s")])
    assert priced.first().selling_price == D("0.00")
    ing, rl, rec, sizes, types = tiny
    c = C.recipe_costing(rec, types, sizes, rl, ing).first()
    assert c.profit is None and c.profit_margin_pct is None


def test_zero_price_gives_profit_but_null_margin(spark):
    ing, rl, rec, sizes, types = _tiny(spark, [("a", "1", "10", False, "included_fixed", 0, False)], base_price="0")
    c = C.recipe_costing(rec, types, sizes, rl, ing).first()
    assert c.profit == D("-10.00000") and c.profit_margin_pct is None


def test_inactive_type_accepted_and_reject_order(spark):
    tiny = _tiny(spark, [("a", "1", "10", False, "included_fixed", 0, False)])
    reqs = [request("ok", 1, "t", "s"), request("n", 2, "t", "s", name="   "),
            request("p", 3, "t", "s", name="   ", phone=""),
            request("q", 4, "t", "s", phone=None), request("z", 5, "t", "nosize"), request("y", 6, "u", "s"),
            request("tab", 7, "t", "s", name="\t")]
    priced, rejected = _priced(spark, tiny, reqs)
    assert sorted(r.order_id for r in priced.collect()) == ["ok", "tab"]  # trim strips spaces only
    assert {r.request_id: r.reject_reason for r in rejected.collect()} == {
        "n": "blank_name", "p": "blank_name", "q": "blank_phone", "z": "size_unavailable",
        "y": "recipe_unavailable"}


def test_hidden_addon_charged_by_server_not_preview(spark):
    tiny = _tiny(spark, [("a", "1", "10", True, "extra_cost_addon", 700, True)], visible=False)
    priced, _ = _priced(spark, tiny, [request("x", 1, "t", "s", [], ["a"])])
    assert priced.first().selling_price == D("8700.00")
    ing, rl, rec, sizes, _ = tiny
    menu = C.recipe_menu(rec, sizes, rl, ing)
    mm = O.preview_mismatches(priced, menu).collect()
    assert [(r.order_id, r.preview_price) for r in mm] == [("x", D("8000.00"))]


def _orders(spark, rows):
    return spark.createDataFrame(rows, "id string, customer_id string, product_type_id string, size_id string, "
                                       "status string, selling_price decimal(12,2), subtotal_cost decimal(12,2), "
                                       "profit decimal(12,2), needs_price_confirmation boolean, "
                                       "customer_notes string, pickup_date date, pickup_time string, "
                                       "created_at timestamp")


def test_cancelled_in_and_out_per_report(spark):
    d = dt.date(2024, 5, 1)
    ts = dt.datetime(2024, 5, 1, 9)
    o = _orders(spark, [
        ("a", "c", "t", "s", "جديد", D(100), D(60), D(40), False, None, d, "11:00:00", ts),
        ("b", "c", "t", "s", "ملغي", D(50), D(20), D(30), False, None, d, None, ts),
        ("c", "c", "t", "s", "ملغي", D(70), D(20), D(50), False, None, d + dt.timedelta(days=2), None, ts),
        ("e", "c", "t", "s", "جاهز", None, D(20), None, True, "حساسية من الباقلاء", d + dt.timedelta(days=3),
         None, ts)])
    k = R.day_kpis(o, d).first()
    assert (k.orders_created, k.pickups, k.sales, k.cost, k.profit) == (4, 2, D(100), D(80), D(40))
    cust = spark.createDataFrame([("c", "name", "0770")], "id string, name string, phone string")
    types = spark.createDataFrame([("t", "type")], "id string, name string")
    sizes = spark.createDataFrame([("s", "size")], "id string, name string")
    up = [r.id for r in L.upcoming_orders(o, cust, types, sizes, d).collect()]
    assert up == ["e"]  # cancelled c is excluded
    facts = L.order_facts(o, cust, types, sizes)
    assert [r.id for r in L.pickups_on(facts, d).collect()] == ["a", "b"]  # cancelled included, NULL time last
    board = {r.id: r for r in L.order_board(o, cust, types, sizes).collect()}
    assert board["e"].allergy_note and board["e"].price_pending and not board["a"].allergy_note


def test_customer_list_never_ordered_last(spark):
    c = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", None), ("c", dt.datetime(2024, 2, 1))],
                              "id string, last_order_at timestamp")
    assert [r.id for r in L.customer_list(c).collect()] == ["c", "a", "b"]


def test_renamed_ingredient_gives_two_rows(spark, kitchen):
    lines = spark.createDataFrame(
        [("o1", "i1", "onion", True, D("1.000")), ("o2", "i1", "red onion", True, D("2.000"))],
        "order_id string, ingredient_id string, ingredient_name_snapshot string, is_included boolean, "
        "quantity_snapshot decimal(12,3)")
    o = spark.createDataFrame([("o1", "جديد", dt.date(2024, 1, 2)), ("o2", "تم التسليم", dt.date(2024, 1, 3))],
                              "id string, status string, pickup_date date")
    got = sorted((r.ingredient_name, r.total_quantity) for r in
                 R.ingredient_needs(lines, o, kitchen.ingredients, "2024-01-01", "2024-01-07").collect())
    assert got == [("onion", D("1.000")), ("red onion", D("2.000"))]  # delivered orders count


def test_top_excluded_tie_break(spark):
    stats = spark.createDataFrame([("b", 5, 3), ("a", 5, 3), ("c", 9, 3), ("d", 0, 0)],
                                  "ingredient_name string, included_count long, excluded_count long")
    assert [r.ingredient_name for r in R.top_excluded(stats).collect()] == ["c", "a", "b"]
    assert [r.ingredient_name for r in R.top_selected(stats, 2).collect()] == ["c", "a"]


def test_sales_ranking_grouping_sets(spark):
    o = _orders(spark, [
        ("a", "c", "t1", "s1", "جديد", D(1), D(1), D(0), False, None, None, None, dt.datetime(2024, 1, 1)),
        ("b", "c", "t1", "s2", "جديد", D(1), D(1), D(0), False, None, None, None, dt.datetime(2024, 1, 1)),
        ("c", "c", "zz", "s2", "جديد", D(1), D(1), D(0), False, None, None, None, dt.datetime(2024, 1, 1)),
        ("d", "c", "t1", "s2", "ملغي", D(1), D(1), D(0), False, None, None, None, dt.datetime(2024, 1, 1))])
    types = spark.createDataFrame([("t1", "regular")], "id string, name string")
    sizes = spark.createDataFrame([("s1", "size 1"), ("s2", "size 2")], "id string, name string")
    got = {(r.dimension, r.name): r.order_count for r in
           R.sales_ranking(o, types, sizes, "2024-01-01", "2024-01-01").collect()}
    assert got == {("type", "regular"): 2, ("type", "—"): 1, ("size", "size 2"): 2, ("size", "size 1"): 1,
                   ("total", None): 3}


def test_ledger_clamps_at_zero(spark):
    ev = spark.createDataFrame(
        [("c", 1, "add", D(10), dt.datetime(2024, 1, 1)), ("c", 2, "delete", D(15), dt.datetime(2024, 1, 2)),
         ("c", 3, "add", D(3), dt.datetime(2024, 1, 3)), ("d", 1, "delete", D(5), dt.datetime(2024, 1, 1))],
        "customer_id string, seq long, kind string, amount decimal(12,2), ts timestamp")
    got = {r.customer_id: (r.total_orders, r.total_spent, r.last_order_at) for r in CU.customer_ledger(ev).collect()}
    assert got == {"c": (1, D("3.00"), dt.datetime(2024, 1, 3)), "d": (0, D("0.00"), None)}


def test_upsert_latest_name_and_non_null_address(spark):
    existing = spark.createDataFrame([(1, "Old", "0770", "home")], "id long, name string, phone string, "
                                                                    "address string")
    orders = spark.createDataFrame(
        [(" 0770 ", "Ann", None, 1, T0), ("0770", "Anne", "", 2, T0), ("0770", "Annie", None, 3, T0),
         ("0790", "Bob", None, 4, T0)],
        "customer_phone string, customer_name string, customer_address string, seq long, created_at timestamp")
    got = {r.phone: (r.id, r.name, r.address) for r in CU.upsert_customers(existing, orders).collect()}
    assert got["0770"] == (1, "Annie", "")  # empty string is a value
    assert got["0790"][1:] == ("Bob", None) and got["0790"][0] is not None


def test_phone_spellings_become_one():
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    df = s.createDataFrame([("07701234567",), ("+9647701234567",), ("009647701234567",), ("7701234567",),
                            ("0770 123-4567",), ("0770 123 4567",)], "phone string")
    assert {r.p for r in df.select(standard_phone("phone").alias("p")).collect()} == {"+9647701234567"}


def test_flag_allergy_lines(spark):
    o = spark.createDataFrame([("a", None), ("b", "no")], "id string, customer_notes string")
    lines = spark.createDataFrame([("b", True, True), ("a", False, True)],
                                  "order_id string, is_included boolean, is_allergen boolean")
    got = {r.id: (r.allergy_note, r.allergen_line) for r in L.flag_allergy_notes(o, lines).collect()}
    assert got == {"a": (False, False), "b": (False, True)}


def test_new_recipe_lines_get_editor_defaults(spark, kitchen):
    from larder.operators.changes import new_line_defaults
    added = spark.createDataFrame([("r1", "i11", D("0.200"), 5), ("r1", "i12", D("0.100"), 9), ("r4", "i13", D("1.0"), 7)],
                                  "recipe_id string, ingredient_id string, quantity decimal(12,3), seq long")
    got = {(r.recipe_id, r.ingredient_id): (r.display_order, r.pricing_rule, r.is_customer_optional, r.price_delta)
           for r in new_line_defaults(kitchen.lines, added).collect()}
    assert got == {("r1", "i11"): (11, "included_fixed", False, D("0.00")),
                   ("r1", "i12"): (12, "included_fixed", False, D("0.00")),
                   ("r4", "i13"): (14, "included_fixed", False, D("0.00"))}


def test_report_days_follow_report_tz(spark):
    o = spark.createDataFrame(
        [("a", "جديد", D(10), D(1), dt.datetime(2024, 1, 1, 22, 30)),   # UTC; 01:30 on Jan 2 in Baghdad (+3)
         ("b", "جديد", D(20), D(2), dt.datetime(2024, 1, 1, 20, 0))],   # 23:00 on Jan 1 in Baghdad
        "id string, status string, selling_price decimal(12,2), profit decimal(12,2), created_at timestamp")
    utc = R.sales_between(o, "2024-01-01", "2024-01-01").first()
    bgw = R.sales_between(o, "2024-01-01", "2024-01-01", report_tz="Asia/Baghdad").first()
    assert (utc.order_count, utc.sales) == (2, D(30))
    assert (bgw.order_count, bgw.sales) == (1, D(20))


def test_price_preview_direct(spark):
    ing, rl, rec, sizes, _ = _tiny(spark, [("a", "1", "10", True, "included_reduce_on_remove", 250, False),
                                          ("b", "1", "10", True, "extra_cost_addon", 900, True)])
    menu = C.recipe_menu(rec, sizes, rl, ing)
    reqs = spark.createDataFrame([("x", "r", ["a"], ["b"]), ("y", "r", None, None)],
                                 "request_id string, recipe_id string, excluded_ids array<string>, "
                                 "extra_ids array<string>")
    got = {r.request_id: r.preview_price for r in O.price_preview(reqs, menu).collect()}
    assert got == {"x": D("8650.00"), "y": D("8000.00")}  # 8000 - 250 + 900; NULL selections change nothing
    _, _, rec_c, sizes_c, _ = _tiny(spark, [("a", "1", "10", True, "included_fixed", 0, False)], mode="custom")
    menu_c = C.recipe_menu(rec_c, sizes_c, rl, ing)
    assert O.price_preview(reqs, menu_c).first().preview_price is None


def test_recipe_lines_view_order_and_names(kitchen):
    rows = [r for r in C.recipe_lines_view(kitchen.lines, kitchen.ingredients).collect() if r.recipe_id == "r4"]
    assert [r.display_order for r in rows] == sorted(r.display_order for r in rows)
    assert rows[0].ingredient_name == "onion" and rows[-1].ingredient_name == "extra meat"


def test_needs_between_drops_fully_cancelled_days(spark):
    from larder.streaming import needs_between
    state = spark.createDataFrame(
        [(dt.date(2024, 1, 2), "i1", "onion", "kg", D("1.000")), (dt.date(2024, 1, 3), "i1", "onion", "kg", D("2.000")),
         (dt.date(2024, 1, 3), "i2", "rice", "kg", D("0.000")), (dt.date(2024, 1, 9), "i1", "onion", "kg", D("5.000"))],
        "pickup_date date, ingredient_id string, ingredient_name_snapshot string, unit string, "
        "total_quantity decimal(22,3)")
    got = {(r.ingredient_id, r.total_quantity) for r in needs_between(state, "2024-01-01", "2024-01-07").collect()}
    assert got == {("i1", D("3.000"))}
