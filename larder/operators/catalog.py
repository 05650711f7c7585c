"""Ops 3-8: the recipe dimension (types, sizes, ingredients, recipes, lines).

Dimensions are small next to orders, but nothing here assumes it: joins carry no hint: Spark picks by bytes, AQE re-plans from run-time sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.money import margin_pct, to_qty
from larder.schemas import ADDON


def active_catalog(df: DataFrame, order_by: Sequence[str | Column], is_admin: bool = False,
                   key: str = "id") -> DataFrame:
    """Op 3: active rows (all rows for an admin), sorted with a key tie-break."""
    return df.filter(F.col("is_active") | F.lit(is_admin)).orderBy(*order_by, key)


def recipe_catalog(recipes: DataFrame, types: DataFrame, sizes: DataFrame, is_admin: bool = True) -> DataFrame:
    """Op 3: recipes with their type and size names, by type then size order."""
    t = types.select(F.col("id").alias("product_type_id"), F.col("name").alias("product_type_name"),
                     F.col("display_order").alias("_type_order"))
    s = sizes.select(F.col("id").alias("size_id"), F.col("name").alias("size_name"),
                     F.col("display_order").alias("_size_order"))
    r = recipes.filter(F.col("is_active") | F.lit(is_admin))
    out = (r.join(t, "product_type_id", "left")
            .join(s, "size_id", "left"))
    return out.orderBy("_type_order", "_size_order", "id").drop("_type_order", "_size_order")


def recipe_lines_view(lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Op 3: each recipe's lines with the ingredient name, by display order."""
    ing = ingredients.select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient_name"),
                             F.col("is_active").alias("ingredient_is_active"))
    return (lines.join(ing, "ingredient_id", "left")
                 .orderBy("recipe_id", "display_order", "ingredient_id"))


# Customer-safe fields of a menu line, in array sort order (display_order first).
_MENU_FIELDS = ("display_order", "ingredient_id", "name", "is_customer_optional", "is_customer_removable",
                "is_core", "is_allergen", "pricing_rule", "price_delta", "is_addon", "default_included")


def recipe_menu(recipes: DataFrame, sizes: DataFrame, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Op 4: one row per active recipe of an active size, with its menu lines.

    Lines are those of active and visible ingredients, ordered by display order;
    no cost field leaves this operator. The base price shows only under fixed
    pricing. A recipe without such lines gets an empty array.

    The array holds one recipe's lines; (recipe, ingredient) is unique, so its
    length is bounded by the ingredient catalog, not by the data volume.
    """
    ing = (ingredients.filter(F.col("is_active") & F.col("is_visible_to_customer"))
           .select(F.col("id").alias("ingredient_id"), "name", "is_customer_removable", "is_core", "is_allergen"))
    shown = (lines.join(ing, "ingredient_id")
             .withColumn("default_included", F.col("pricing_rule") != F.lit(ADDON)))
    arrays = shown.groupBy("recipe_id").agg(
        F.sort_array(F.collect_list(F.struct(*_MENU_FIELDS))).alias("ingredients"))
    active_sizes = sizes.filter(F.col("is_active")).select(F.col("id").alias("size_id"), "pricing_mode")
    base = (recipes.filter(F.col("is_active"))
            .select(F.col("id").alias("recipe_id"), "product_type_id", "size_id", "base_selling_price")
            .join(active_sizes, "size_id"))
    menu = base.join(arrays, "recipe_id", "left")
    empty = F.array().cast(arrays.schema["ingredients"].dataType)
    return menu.select(
        "recipe_id", "product_type_id", "size_id", "pricing_mode",
        F.when(F.col("pricing_mode") == "fixed", F.col("base_selling_price")).alias("base_selling_price"),
        F.coalesce(F.col("ingredients"), empty).alias("ingredients"))


def _toggleable(l: Column) -> Column:
    return F.coalesce(l["is_customer_optional"] & l["is_customer_removable"] & (l["pricing_rule"] != ADDON),
                      F.lit(False))


def menu_sections(menu: DataFrame) -> DataFrame:
    """Op 5: which section of the order form shows each menu line.

    The sets overlap, so they are four booleans, not one label. The recipe-level
    allergen warning is computed on the array, row-wise, before the explode.
    """
    warned = menu.select(
        "recipe_id", "ingredients",
        F.exists("ingredients", lambda l: _toggleable(l) & F.coalesce(l["is_allergen"], F.lit(False)))
        .alias("has_allergen_warning"))
    lines = warned.select("recipe_id", "has_allergen_warning", F.inline("ingredients"))
    is_addon_rule = F.coalesce(F.col("pricing_rule") == ADDON, F.lit(False))
    toggle = _toggleable(F.struct("is_customer_optional", "is_customer_removable", "pricing_rule"))
    is_addon = F.coalesce(F.col("is_addon"), F.lit(False))
    return lines.select(
        "recipe_id", "ingredient_id", "name", "display_order", "has_allergen_warning",
        toggle.alias("is_toggleable"),
        (F.coalesce(F.col("is_customer_optional"), F.lit(False)) & is_addon_rule).alias("is_optional_addon"),
        (~toggle & ~is_addon & ~is_addon_rule).alias("is_fixed"),
        (is_addon & ~is_addon_rule).alias("is_fixed_addon"))


def scale_recipes(base_lines: DataFrame, recipes: DataFrame, sizes: DataFrame,
                  unscaled_col: str = "is_unscaled") -> DataFrame:
    """Op 6: expand a product type's base lines to each of its recipes.

    quantity = round(base * size multiplier, 2); lines flagged unscaled keep the
    base quantity. An equi-join on the product type, then on the size; recipes
    and sizes are dimension tables, which Spark broadcasts while they are small.
    """
    r = recipes.select(F.col("id").alias("recipe_id"), "product_type_id", "size_id")
    s = sizes.select(F.col("id").alias("size_id"), "multiplier")
    out = (base_lines.join(r, "product_type_id")
                     .join(s, "size_id"))
    scaled = F.when(F.coalesce(F.col(unscaled_col), F.lit(False)), F.col("quantity")) \
        .otherwise(F.round(F.col("quantity") * F.col("multiplier"), 2))
    return out.withColumn("quantity", to_qty(scaled)).drop("multiplier")


def unused_ingredients(recipe_id: object, ingredients: DataFrame, lines: DataFrame) -> DataFrame:
    """Op 7: the active ingredients the given recipe does not use yet (the
    candidates to add while editing it).

    One anti join: the catalog scan against that recipe's lines, which the
    filter pushes down and whose size is bounded by the catalog ((recipe,
    ingredient) is unique).
    """
    used = lines.filter(F.col("recipe_id") == F.lit(recipe_id)).select("ingredient_id")
    active = ingredients.filter(F.col("is_active")).select(F.col("id").alias("ingredient_id"), "name")
    return (active.join(used, "ingredient_id", "left_anti")
            .withColumn("recipe_id", F.lit(recipe_id))
            .orderBy("name", "ingredient_id"))


def line_cost_unrounded(rule: Column, cost_method: Column, direct_cost: Column, quantity: Column,
                        unit_price: Column) -> Column:
    """Costing-view line cost: 0 for an add-on, direct cost, else quantity x price (scale 5)."""
    return (F.when(rule == ADDON, F.lit(0))
            .when(cost_method == "direct", direct_cost)
            .otherwise(quantity * unit_price))


def recipe_costing(recipes: DataFrame, types: DataFrame, sizes: DataFrame, lines: DataFrame,
                   ingredients: DataFrame) -> DataFrame:
    """Op 8: per recipe total cost, profit and margin.

    total_cost = sum of line costs (unrounded) + packaging + extra. Inactive and
    hidden ingredients count. Recipes without lines cost packaging + extra.
    Line costs are pre-aggregated per recipe (partial aggregation), so the
    recipe join sees one row per recipe.
    """
    ing = ingredients.select(F.col("id").alias("ingredient_id"), "cost_method", "direct_cost", "unit_price")
    costs = (lines.join(ing, "ingredient_id", "left")
             .groupBy("recipe_id")
             .agg(F.sum(line_cost_unrounded(F.col("pricing_rule"), F.col("cost_method"), F.col("direct_cost"),
                                            F.col("quantity"), F.col("unit_price"))).alias("lines_cost")))
    t = types.select(F.col("id").alias("product_type_id"), F.col("name").alias("product_type_name"))
    s = sizes.select(F.col("id").alias("size_id"), F.col("name").alias("size_name"), "pricing_mode")
    r = recipes.select(F.col("id").alias("recipe_id"), F.col("name").alias("recipe_name"), "product_type_id",
                       "size_id", "packaging_cost", "extra_cost", "base_selling_price")
    joined = (r.join(t, "product_type_id")
               .join(s, "size_id")
               .join(costs, "recipe_id", "left"))
    total = F.coalesce(F.col("lines_cost"), F.lit(0)) + F.col("packaging_cost") + F.col("extra_cost")
    joined = joined.withColumn("total_cost", total)
    profit = F.when(F.col("base_selling_price").isNull(), F.lit(None)) \
        .otherwise(F.col("base_selling_price") - F.col("total_cost"))
    return joined.select(
        "recipe_id", "recipe_name", "product_type_name", "size_name", "pricing_mode", "total_cost",
        "base_selling_price", profit.alias("profit"),
        margin_pct(F.col("base_selling_price") - F.col("total_cost"), F.col("base_selling_price"))
        .alias("profit_margin_pct"))


def price_list(costing: DataFrame) -> DataFrame:
    """The costing list as the pricing page shows it: by type name."""
    return costing.orderBy("product_type_name", "size_name", "recipe_id")
