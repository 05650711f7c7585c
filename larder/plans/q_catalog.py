"""Registered catalog queries (ops 3-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import catalog as C
from larder.plans import bindings as b
from larder.plans.registry import _t, money_out, register


@register("active_catalog")
def q_active_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3: each recipe's lines of active ingredients, by display order."""
    t = _t(spark, sf_dir)
    view = C.recipe_lines_view(b.recipe_lines(t), b.ingredients(t)).withColumnRenamed("ingredient_is_active",
                                                                                       "is_active")
    out = C.active_catalog(view, ["recipe_id", "display_order"], key="ingredient_id")
    return out.select("recipe_id", "ingredient_id", "ingredient_name", "display_order")


@register("recipe_catalog")
def q_recipe_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3: the active recipes with their type and size names."""
    t = _t(spark, sf_dir)
    out = C.recipe_catalog(b.recipes(t), b.product_types(t), b.sizes(t), is_admin=False)
    return money_out(out.select("id", "name", "product_type_name", "size_name", "base_selling_price"))


@register("recipe_menu")
def q_recipe_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    menu = C.recipe_menu(b.recipes(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t))
    return money_out(menu.select(
        "recipe_id", "pricing_mode", "base_selling_price",
        F.size("ingredients").cast("long").alias("n_lines"),
        F.array_join(F.transform("ingredients", lambda l: l["ingredient_id"].cast("string")), ",")
        .alias("line_ids"),
        F.size(F.filter("ingredients", lambda l: l["default_included"])).cast("long").alias("n_default_included")))


@register("menu_sections")
def q_menu_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    menu = C.recipe_menu(b.recipes(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t))
    return C.menu_sections(menu).select("recipe_id", "ingredient_id", "is_toggleable", "is_optional_addon",
                                        "is_fixed", "is_fixed_addon", "has_allergen_warning")


@register("scale_recipes")
def q_scale_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    base = t.part.select((F.col("p_partkey") % 5).cast("int").alias("product_type_id"),
                         F.col("p_partkey").alias("ingredient_id"),
                         F.expr("cast(p_size / 8.0 as decimal(12,3))").alias("quantity"),
                         (F.col("p_size") % 10 == 0).alias("is_unscaled"))
    recipes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("product_type_id"),
                              (F.col("n_nationkey") % 5).alias("size_id"))
    sizes = t.region.select(F.col("r_regionkey").alias("id"),
                            F.expr("cast(1 + r_regionkey * 0.6 as decimal(3,1))").alias("multiplier"))
    out = C.scale_recipes(base, recipes, sizes)
    return money_out(out.select("recipe_id", "ingredient_id", "quantity"))


@register("recipe_costing")
def q_recipe_costing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    out = C.recipe_costing(b.recipes(t), b.product_types(t), b.sizes(t), b.recipe_lines(t), b.ingredients(t))
    return money_out(out)


EDITED_RECIPE = 7  # the recipe open in the editor (the operator's parameter)


@register("unused_ingredients")
def q_unused_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7: candidates to add to the recipe being edited, over the whole catalog."""
    t = _t(spark, sf_dir)
    return C.unused_ingredients(EDITED_RECIPE, b.ingredients(t), b.recipe_lines(t)).select(
        "recipe_id", "ingredient_id", "name")
