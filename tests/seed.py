"""The kitchen's sample data as small Spark tables, for hand-computed tests.

Fixed values from the sample data: 3 types, 3 sizes (the third custom),
14 ingredients, 9 recipes, and 102 recipe lines built from 10 base lines per
recipe (scaled 1.0 for size 1, 1.6 otherwise) plus the meat, add-on and rib
lines. Ids are short strings: i1..i14, r1..r9, t1..t3, s1..s3.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D
from types import SimpleNamespace

from pyspark.sql import functions as F

from larder.operators.catalog import scale_recipes
from larder.schemas import INGREDIENTS, PRODUCT_TYPES, RECIPE_LINES, RECIPES, SIZES

T0 = dt.datetime(2024, 1, 1)

# Fixed values: (id, name, unit, unit_price, cost_method, direct_cost, removable, core, allergen)
INGREDIENT_ROWS = [
    ("i1", "onion", "kg", 1000, "quantity", 0, True, False, False),
    ("i2", "tomato", "kg", 1000, "quantity", 0, True, False, False),
    ("i3", "pepper", "kg", 1500, "quantity", 0, True, False, False),
    ("i4", "shajar", "kg", 1000, "quantity", 0, True, False, False),
    ("i5", "eggplant", "kg", 1000, "quantity", 0, True, False, False),
    ("i6", "chard leaves", "kg", 1500, "quantity", 0, True, False, False),
    ("i7", "broad beans", "kg", 2000, "quantity", 0, True, False, True),
    ("i8", "rice", "kg", 2000, "quantity", 0, False, True, False),
    ("i9", "parsley", "bunch", 500, "quantity", 0, False, True, False),
    ("i10", "spices", "meal", 0, "direct", 750, False, True, False),
    ("i11", "meat", "kg", 12000, "quantity", 0, False, False, False),
    ("i12", "liyah", "kg", 8000, "quantity", 0, False, False, False),
    ("i13", "lamb ribs", "kg", 15000, "quantity", 0, False, False, False),
    ("i14", "extra meat", "kg", 12000, "quantity", 0, True, False, False),
]
# (ingredient, base quantity, optional, display order); i10 keeps quantity 1 at every size.
BASE_LINES = [("i1", "0.5", True, 1), ("i2", "0.5", True, 2), ("i3", "0.3", True, 3), ("i4", "0.3", True, 4),
              ("i5", "0.5", True, 5), ("i6", "0.3", True, 6), ("i7", "0.3", True, 7), ("i8", "0.5", False, 8),
              ("i9", "0.1", False, 9), ("i10", "1", False, 10)]
# (recipe, type, size, base price)
RECIPE_ROWS = [("r1", "t1", "s1", 8000), ("r2", "t1", "s2", 12000), ("r3", "t1", "s3", None),
               ("r4", "t2", "s1", 13000), ("r5", "t2", "s2", 18000), ("r6", "t2", "s3", None),
               ("r7", "t3", "s1", 15000), ("r8", "t3", "s2", 22000), ("r9", "t3", "s3", None)]
# (recipe, ingredient, quantity, optional, rule, delta, is_addon, display order)
EXTRA_LINES = [
    ("r4", "i11", "0.5", False, "included_fixed", 0, True, 20), ("r4", "i12", "0.15", False, "included_fixed", 0, True, 21),
    ("r5", "i11", "0.8", False, "included_fixed", 0, True, 20), ("r5", "i12", "0.25", False, "included_fixed", 0, True, 21),
    ("r6", "i11", "0.8", False, "included_fixed", 0, True, 20), ("r6", "i12", "0.25", False, "included_fixed", 0, True, 21),
    ("r4", "i14", "0.25", True, "extra_cost_addon", 3000, True, 22),
    ("r5", "i14", "0.25", True, "extra_cost_addon", 3000, True, 22),
    ("r6", "i14", "0.25", True, "extra_cost_addon", 3000, True, 22),
    ("r7", "i13", "1.0", False, "included_fixed", 0, True, 20),
    ("r8", "i13", "1.5", False, "included_fixed", 0, True, 20),
    ("r9", "i13", "1.5", False, "included_fixed", 0, True, 20),
]


def build_kitchen(spark):
    types = spark.createDataFrame(
        [(f"t{i}", k, n, None, i, True, T0) for i, k, n in
         [(1, "regular", "regular pot"), (2, "meat_liyah", "meat and liyah pot"), (3, "lamb_ribs", "lamb ribs pot")]],
        PRODUCT_TYPES)
    sizes = spark.createDataFrame(
        [("s1", "size1", "size 1", "2-3", "fixed", 1, True, T0), ("s2", "size2", "size 2", "4-5", "fixed", 2, True, T0),
         ("s3", "custom", "size 3", "custom", "custom", 3, True, T0)], SIZES)
    ingredients = spark.createDataFrame(
        [(i, n, u, D(p), m, D(dc), True, True, rem, core, alg, None, T0, T0)
         for i, n, u, p, m, dc, rem, core, alg in INGREDIENT_ROWS], INGREDIENTS)
    recipes = spark.createDataFrame(
        [(r, t, s, f"recipe {r}", D(1000), D(0), None if p is None else D(p), True, T0, T0)
         for r, t, s, p in RECIPE_ROWS], RECIPES)
    base = spark.createDataFrame(
        [(t, i, D(q), opt, o, i == "i10") for t in ("t1", "t2", "t3") for i, q, opt, o in BASE_LINES],
        "product_type_id string, ingredient_id string, quantity decimal(12,3), is_customer_optional boolean, "
        "display_order int, is_unscaled boolean")
    mult = spark.createDataFrame([("s1", D("1.0")), ("s2", D("1.6")), ("s3", D("1.6"))],
                                 "id string, multiplier decimal(3,1)")
    scaled = scale_recipes(base, recipes, mult).select(
        F.concat_ws(":", "recipe_id", "ingredient_id").alias("id"), "recipe_id", "ingredient_id", "quantity",
        "is_customer_optional", F.lit("included_fixed").alias("pricing_rule"),
        F.lit(0).cast("decimal(12,2)").alias("price_delta"), F.lit(False).alias("is_addon"), "display_order",
        F.lit(T0).alias("created_at"))
    extra = spark.createDataFrame(
        [(f"{r}:{i}", r, i, D(q), opt, rule, D(delta), addon, o, T0) for r, i, q, opt, rule, delta, addon, o in
         EXTRA_LINES], RECIPE_LINES)
    lines = spark.createDataFrame(scaled.unionByName(extra).collect(), RECIPE_LINES)
    return SimpleNamespace(types=types, sizes=sizes, ingredients=ingredients, recipes=recipes, lines=lines)


REQUEST_SCHEMA = ("request_id string, seq long, created_at timestamp, product_type_id string, size_id string, "
                  "customer_name string, customer_phone string, pickup_date date, pickup_time string, "
                  "customer_notes string, customer_address string, excluded_ids array<string>, "
                  "extra_ids array<string>")


def request(rid, seq, type_id, size_id, excluded=(), extras=(), name="Sara", phone="07700000001",
            pickup=dt.date(2024, 1, 10), created=None, notes=None, address=None):
    return (rid, seq, created or T0 + dt.timedelta(hours=seq), type_id, size_id, name, phone, pickup, "10:00:00",
            notes, address, None if excluded is None else list(excluded), None if extras is None else list(extras))
