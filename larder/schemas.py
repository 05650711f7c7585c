"""Domain schemas and the fixed values the kitchen's data model defines.

Ids are strings in the kitchen's own tables; the operators never look inside an
id, so the test-data bindings keep their integer keys.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the data model's enum labels and constants).
# Order status labels, in their defined order; the last one is "cancelled".
ORDER_STATUSES = ("جديد", "تم التأكيد", "قيد التحضير", "جاهز", "تم التسليم", "ملغي")
CANCELLED = "ملغي"
COST_METHODS = ("quantity", "direct")
PRICING_MODES = ("fixed", "custom")
PRICING_RULES = ("included_fixed", "included_reduce_on_remove", "extra_cost_addon")
ORDER_NUMBER_PREFIX = "DLM"
ALLERGY_NOTE_PATTERN = "حساس"
PHONE_COUNTRY_CODE = "+964"
NOTE_MAX_CHARS = 1000
ORDER_BOARD_LIMIT = 200
UPCOMING_LIMIT = 10
RANKING_LIMIT = 8
MISSING_NAME = "—"
# ---------------------------------------------------------------------------

ADDON = "extra_cost_addon"
REDUCE_ON_REMOVE = "included_reduce_on_remove"

MONEY = T.DecimalType(12, 2)
QTY = T.DecimalType(12, 3)
S, I, B, TS, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DateType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PRODUCT_TYPES = _schema(("id", S), ("key", S), ("name", S), ("description", S), ("display_order", I),
                        ("is_active", B), ("created_at", TS))
SIZES = _schema(("id", S), ("key", S), ("name", S), ("people_range", S), ("pricing_mode", S),
                ("display_order", I), ("is_active", B), ("created_at", TS))
INGREDIENTS = _schema(("id", S), ("name", S), ("unit", S), ("unit_price", MONEY), ("cost_method", S),
                      ("direct_cost", MONEY), ("is_active", B), ("is_visible_to_customer", B),
                      ("is_customer_removable", B), ("is_core", B), ("is_allergen", B), ("notes", S),
                      ("created_at", TS), ("updated_at", TS))
RECIPES = _schema(("id", S), ("product_type_id", S), ("size_id", S), ("name", S), ("packaging_cost", MONEY),
                  ("extra_cost", MONEY), ("base_selling_price", MONEY), ("is_active", B), ("created_at", TS),
                  ("updated_at", TS))
RECIPE_LINES = _schema(("id", S), ("recipe_id", S), ("ingredient_id", S), ("quantity", QTY),
                       ("is_customer_optional", B), ("pricing_rule", S), ("price_delta", MONEY), ("is_addon", B),
                       ("display_order", I), ("created_at", TS))
CUSTOMERS = _schema(("id", S), ("name", S), ("phone", S), ("address", S), ("total_orders", I),
                    ("total_spent", MONEY), ("last_order_at", TS), ("created_at", TS))
ORDERS = _schema(("id", S), ("order_number", S), ("customer_id", S), ("product_type_id", S), ("size_id", S),
                 ("recipe_id", S), ("status", S), ("subtotal_cost", MONEY), ("selling_price", MONEY),
                 ("profit", MONEY), ("needs_price_confirmation", B), ("customer_notes", S), ("admin_notes", S),
                 ("pickup_date", D), ("pickup_time", S), ("created_at", TS), ("updated_at", TS))
ORDER_LINES = _schema(("id", S), ("order_id", S), ("ingredient_id", S), ("ingredient_name_snapshot", S),
                      ("is_included", B), ("quantity_snapshot", QTY), ("unit_price_snapshot", MONEY),
                      ("cost_snapshot", MONEY), ("price_delta_applied", MONEY), ("is_allergen", B),
                      ("created_at", TS))
ORDER_REQUESTS = _schema(("request_id", S), ("seq", T.LongType()), ("created_at", TS), ("product_type_id", S),
                         ("size_id", S), ("customer_name", S), ("customer_phone", S), ("pickup_date", D),
                         ("pickup_time", S), ("customer_notes", S), ("customer_address", S),
                         ("excluded_ids", T.ArrayType(S)), ("extra_ids", T.ArrayType(S)))

DOMAIN = {
    "product_types": PRODUCT_TYPES,
    "sizes": SIZES,
    "ingredients": INGREDIENTS,
    "recipes": RECIPES,
    "recipe_lines": RECIPE_LINES,
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "order_lines": ORDER_LINES,
    "order_requests": ORDER_REQUESTS,
}
