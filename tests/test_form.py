"""Numbers as typed, ticked selections and the order form's rule."""

import random
from decimal import Decimal as D

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.functions.numbers import edited_money, edited_number
from larder.operators import catalog as C
from larder.operators import orders as O
from tests.seed import REQUEST_SCHEMA, request

# Each class of the grammar with what Number(text) || 0 gives.
TYPED = {
    None: 0, "": 0, "   ": 0, "﻿  ": 0, " 12.50 ": 12.5, "\t7\n": 7, "　5 ": 5, "5.": 5, ".5": 0.5, "+.25": 0.25, "-3": -3,
    "1e3": 1000, "1.5E-2": 0.015, "1e+2": 100, "007": 7, "-0": 0, "1e400": float("inf"), "-1e999": float("-inf"), "Infinity": float("inf"),
    "+Infinity": float("inf"), "-Infinity": float("-inf"), "infinity": 0, "Inf": 0, "NaN": 0, "0x1F": 31, "0Xff": 255, "0x": 0, "-0x10": 0,
    "0xG": 0, "0b101": 5, "0B2": 0, "0o17": 15, "0O8": 0, "1,5": 0, "1_000": 0, "12abc": 0, "1d": 0, "2f": 0, "0x1p3": 0, ".": 0, "e5": 0,
    "5e": 0, "+-1": 0, "1 2": 0, "٣": 0, "1e-400": 0, "9007199254740993": 9007199254740992, "0x20000000000000": 2.0 ** 53, "--1": 0}


def _read(spark, texts, fn):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", fn("t").alias("x")).orderBy("i").collect()]


def test_every_class_of_the_number_grammar(spark):
    got = dict(zip(TYPED, _read(spark, TYPED, edited_number)))
    assert got == {k: float(v) for k, v in TYPED.items()}
    assert str(got["-0"]) == "0.0"


def test_money_of_edited_numbers(spark):
    texts = ["1.005", "2.345", "-0.125", "9999999999.99", "1e10", "Infinity", "abc", None, "0x10"]
    assert _read(spark, texts, edited_money) == [D("1.01"), D("2.35"), D("-0.13"), D("9999999999.99"), None, None, D("0.00"), D("0.00"), D("16.00")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False).map(repr), st.integers().map(str), st.integers(0, 2 ** 53).map(hex), st.text("0123456789.eE+-x ", max_size=6)),
                min_size=1, max_size=40))
def test_numbers_as_python_reads_them(spark, texts):
    def want(t):
        t = t.strip(" ")
        if t[:2] in ("0x",) and t[2:] and all(c in "0123456789abcdef" for c in t[2:]):
            return float(int(t, 16))
        try:
            return float(t) + 0.0 if not set(t) - set("0123456789.eE+-") else float("inf") if t == "inf" else 0.0
        except ValueError:
            return 0.0
    texts = [t.replace("inf", "Infinity") for t in texts]
    assert _read(spark, texts, edited_number) == [float(t) if t.endswith("Infinity") else want(t) for t in texts]


def _menu(k):
    return C.recipe_menu(k.recipes, k.sizes, k.lines, k.ingredients)


def test_selections_round_trip_through_pricing(spark, kitchen):
    """Random ticks -> id arrays -> the order's price, which is the preview's; and the arrays follow the page's filters."""
    k, rng = kitchen, random.Random(4)
    menu = {r["recipe_id"]: r for r in _menu(k).collect()}
    ids = [r["id"] for r in k.ingredients.collect()] + ["nobody"]
    recipes = {r["id"]: (r["product_type_id"], r["size_id"]) for r in k.recipes.collect()}
    rows = [(f"q{n}", rng.choice([*recipes, "r-none"]), None if n % 9 == 0 else {i: rng.choice([True, False, None]) for i in rng.sample(ids, rng.randrange(8))})
            for n in range(80)]
    ticked = spark.createDataFrame(rows, "request_id string, recipe_id string, ticked map<string,boolean>")
    got = {r["request_id"]: (r["excluded_ids"], r["extra_ids"]) for r in O.selection_arrays(ticked, _menu(k)).collect()}
    for rid, recipe, ticks in rows:
        if recipe not in menu:
            assert got[rid] == (None, None)
            continue
        lines = menu[recipe]["ingredients"]
        chosen = {x["ingredient_id"]: x["default_included"] for x in lines} | (ticks or {})
        assert got[rid] == (
            [x["ingredient_id"] for x in lines if x["pricing_rule"] != "extra_cost_addon" and x["is_customer_optional"] and x["is_customer_removable"]
             and not chosen[x["ingredient_id"]]],
            [x["ingredient_id"] for x in lines if x["pricing_rule"] == "extra_cost_addon" and chosen[x["ingredient_id"]]])
    asked = [request(rid, n, *recipes[recipe], got[rid][0], got[rid][1]) for n, (rid, recipe, _) in enumerate(rows) if recipe in menu]
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    valid, rejected = O.validate_orders(spark.createDataFrame(asked, REQUEST_SCHEMA), k.sizes, dim)
    priced = O.price_orders(valid)
    assert rejected.count() == 0 and priced.count() == len(asked) > 20
    assert O.preview_mismatches(priced, _menu(k)).count() == 0


def test_form_rule(spark, kitchen):
    k = kitchen
    rows = [list(request(f"q{i}", i, "t1", "s1")) for i in range(6)]
    rows[1][7] = None
    rows[2][8] = None
    rows[3][8] = ""
    rows[4][5], rows[4][7] = " ", None
    rows[5][4], rows[5][8] = "nowhere", None
    frame = spark.createDataFrame([tuple(r) for r in rows], REQUEST_SCHEMA)
    dim = O.recipe_dimension(k.recipes, k.lines, k.ingredients)
    found = [{r["request_id"]: r["reject_reason"] for r in O.check_orders(frame, k.sizes, dim, form=f).collect()} for f in (True, False)]
    assert found[0] == {"q0": None, "q1": "pickup_missing", "q2": "pickup_missing", "q3": "pickup_missing", "q4": "blank_name", "q5": "pickup_missing"}
    assert found[1] == {"q0": None, "q1": None, "q2": None, "q3": None, "q4": "blank_name", "q5": "size_unavailable"}
