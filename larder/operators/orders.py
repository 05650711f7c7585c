"""Ops 9-13: validate, price, snapshot and number customised orders.

The flagship. A recipe collapses to one row holding its lines as
`array<struct>`; that dimension is joined to the orders once (broadcast where its
lines are small in bytes), and everything after is row-wise: order totals fold the array
with `aggregate` and `array_contains`, and order lines explode it (`inline`)
and apply the same rules on flat columns. No shuffle of orders, and the same
code serves batch and Structured Streaming micro-batches.

The include / cost / delta rules live only here, in `_included`, `_line_cost`
and `_line_delta`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.money import money_zero, to_money
from larder.schemas import ADDON, ORDER_NUMBER_PREFIX, REDUCE_ON_REMOVE
from larder.session import checkpoint_dir

# Fields of a recipe line inside the recipe dimension, in array sort order.
_LINE_FIELDS = ("display_order", "ingredient_id", "name", "quantity", "unit_price", "direct_cost", "cost_method",
                "pricing_rule", "price_delta", "is_customer_optional", "is_customer_removable", "is_allergen",
                "is_addon", "ingredient_is_active", "ingredient_is_visible")


#: Recipe lines, as Spark estimates them from their files, whose dimension is broadcast. As structs of 15 fields in
#: memory they take some eight times that, so at most about 128 MB are sent.
BROADCAST_BYTES = 16 << 20


def recipe_dimension(recipes: DataFrame, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """One row per recipe with its lines as a sorted `array<struct>`.

    Lines join their ingredient (inner, as pricing needs its price); hidden and
    inactive ingredients stay in, since they still cost and price. A recipe's
    array is bounded by the ingredient catalog ((recipe, ingredient) is unique).
    """
    ing = ingredients.select(
        F.col("id").alias("ingredient_id"), "name", "unit_price", "direct_cost", "cost_method", "is_allergen",
        "is_customer_removable", F.col("is_active").alias("ingredient_is_active"),
        F.col("is_visible_to_customer").alias("ingredient_is_visible"))
    arrays = (lines.join(ing, "ingredient_id")
              .groupBy("recipe_id")
              .agg(F.sort_array(F.collect_list(F.struct(*_LINE_FIELDS))).alias("lines")))
    r = recipes.select(F.col("id").alias("recipe_id"), "product_type_id", "size_id", "base_selling_price",
                       "packaging_cost", "extra_cost", F.col("is_active").alias("recipe_is_active"))
    dim = r.join(arrays, "recipe_id", "left")
    empty = F.array().cast(arrays.schema["lines"].dataType)
    return dim.withColumn("lines", F.coalesce(F.col("lines"), empty))


def broadcast_recipe_dimension(dim: DataFrame, lines: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint the recipe dimension for broadcast if Spark's statistics of the
    recipe lines that build it say at most `max_bytes` (default BROADCAST_BYTES); otherwise, and where
    Spark knows no size, leave the join to Spark. Reads the plan, runs no job."""
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if size <= (BROADCAST_BYTES if max_bytes is None else max_bytes) else dim


def _included(l: Column, excluded: Column, extras: Column) -> Column:
    """An add-on is in iff optional and asked for; any other line is in unless
    optional, removable and asked out. `= any(NULL)` is NULL: for an add-on that
    NULL survives (op 9 rejects it); for other lines it excludes nothing."""
    addon_in = l["is_customer_optional"] & F.array_contains(extras, l["ingredient_id"])
    left_out = F.coalesce(
        l["is_customer_optional"] & l["is_customer_removable"] & F.array_contains(excluded, l["ingredient_id"]),
        F.lit(False))
    return F.when(l["pricing_rule"] == ADDON, addon_in).otherwise(~left_out)


def _line_cost(l: Column, included: Column) -> Column:
    """Per order line, rounded to money on its own (half away from zero)."""
    return to_money(F.when(~included, F.lit(0))
                    .when(l["cost_method"] == "direct", l["direct_cost"])
                    .otherwise(l["quantity"] * l["unit_price"]))


def _line_delta(l: Column, included: Column) -> Column:
    return to_money(F.when((l["pricing_rule"] == REDUCE_ON_REMOVE) & ~included, -l["price_delta"])
                    .when((l["pricing_rule"] == ADDON) & included, l["price_delta"])
                    .otherwise(F.lit(0)))


REJECT_REASONS = ("blank_name", "blank_phone", "size_unavailable", "recipe_unavailable", "null_selection")


#: The order form's own rule, checked after name and phone where `form` asks for it.
FORM_REASON = "pickup_missing"


def check_orders(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame,
                 note_chars: int | None = None, form: bool = False) -> DataFrame:
    """Op 9 in one pass: every request with its size and recipe attached and a
    `reject_reason` (NULL when valid; first match wins).

    blank name, blank phone (trim strips spaces only), size unknown or inactive,
    recipe unknown or inactive for (type, size), then an add-on whose inclusion
    is NULL because the extras array is NULL or holds a NULL. The product type's
    own activity is not checked. Notes stay whole (NULL becomes empty) unless
    the caller states `note_chars`, a length to cut them to. With `form`, the
    order form's rule holds too: a pickup day and a time that isn't empty.
    """
    note = F.coalesce(F.col("customer_notes"), F.lit(""))
    s = sizes.select(F.col("id").alias("size_id"), "pricing_mode", F.col("is_active").alias("size_is_active"))
    j = (requests
         .join(s, "size_id", "left")
         .join(recipe_dim, ["product_type_id", "size_id"], "left"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    null_selection = F.exists(
        "lines", lambda l: (l["pricing_rule"] == ADDON)
        & _included(l, F.col("excluded_ids"), F.col("extra_ids")).isNull())
    no_pickup = F.col("pickup_date").isNull() | (F.coalesce(F.col("pickup_time").cast("string"), F.lit("")) == "")
    reason = (F.when(blank("customer_name"), "blank_name")
              .when(blank("customer_phone"), "blank_phone")
              .when(no_pickup if form else F.lit(False), FORM_REASON)
              .when(~F.coalesce(F.col("size_is_active"), F.lit(False)), "size_unavailable")
              .when(F.col("recipe_id").isNull() | ~F.coalesce(F.col("recipe_is_active"), F.lit(False)),
                    "recipe_unavailable")
              .when(F.coalesce(null_selection, F.lit(False)), "null_selection"))
    return (j.withColumn("reject_reason", reason)
             .withColumn("customer_name", F.trim("customer_name"))
             .withColumn("customer_phone", F.trim("customer_phone"))
             .withColumn("customer_notes", note if note_chars is None else F.substring(note, 1, note_chars)))


def validate_orders(requests: DataFrame, sizes: DataFrame, recipe_dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Op 9: (valid, rejected). Valid rows carry the recipe row, so pricing
    needs no further join; rejected rows are the requests with their reason.
    Both are filters of one `check_orders` plan (persist it to share a scan)."""
    out = check_orders(requests, sizes, recipe_dim)
    valid = out.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = out.filter(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason")
    return valid, rejected


def selection_arrays(requests: DataFrame, menu: DataFrame, ticked: str = "ticked") -> DataFrame:
    """What a customer ticked on the menu -> the request's `excluded_ids` and `extra_ids`, in menu order.

    `requests` has `recipe_id` and a map `ticked` from ingredient to boolean.
    Each menu line starts at its default; the map's entry, where there is one,
    takes its place, a NULL one as not ticked. Left-out lines that are optional
    and removable are excluded, ticked add-ons are extras; ids that the menu
    doesn't show are ignored. Without a map the defaults hold; a recipe that
    the menu lacks has NULL arrays. Row-wise on the recipe's menu array, which
    the catalog bounds; the menu is joined once.
    """
    m = menu.select("recipe_id", F.col("ingredients").alias("_menu_lines"))
    ids = F.map_keys(F.col(ticked))

    def chosen(l: Column) -> Column:
        given = F.coalesce(F.array_contains(ids, l["ingredient_id"]), F.lit(False))
        return F.when(given, F.coalesce(F.try_element_at(F.col(ticked), l["ingredient_id"]), F.lit(False))) \
            .otherwise(F.coalesce(l["default_included"], F.lit(False)))

    def out(l: Column) -> Column:
        free = l["is_customer_optional"] & l["is_customer_removable"] & (l["pricing_rule"] != ADDON)
        return F.coalesce(free, F.lit(False)) & ~chosen(l)

    def extra(l: Column) -> Column:
        return F.coalesce(l["pricing_rule"] == ADDON, F.lit(False)) & chosen(l)

    j = requests.join(m, "recipe_id", "left")
    for name, taken in (("excluded_ids", out), ("extra_ids", extra)):
        j = j.withColumn(name, F.transform(F.filter("_menu_lines", taken), lambda l: l["ingredient_id"]))
    return j.drop("_menu_lines")


def price_orders(valid: DataFrame) -> DataFrame:
    """Op 10: price and cost each order from its recipe row (row-wise).

    subtotal = sum of per-line money costs + packaging + extra; price = base +
    sum of deltas, or NULL with NULL profit and `needs_price_confirmation` for a
    custom size. No floor at 0. Ids not in the recipe are ignored and repeated
    ids count once (membership, never an explode join).

    Higher-order functions run interpreted, so the totals fold the raw line
    structs directly, with no per-line struct rebuild. `lines` stays the
    recipe's lines; op 11 explodes them and applies the same rules on flat,
    code-generated columns.
    """
    ex, xt = F.col("excluded_ids"), F.col("extra_ids")

    def inc(l: Column) -> Column:
        return F.coalesce(_included(l, ex, xt), F.lit(False))

    subtotal = to_money(F.aggregate("lines", money_zero(), lambda acc, l: to_money(acc + _line_cost(l, inc(l))))
                        + F.coalesce(F.col("packaging_cost"), money_zero())
                        + F.coalesce(F.col("extra_cost"), money_zero()))
    adjust = F.aggregate("lines", money_zero(), lambda acc, l: to_money(acc + _line_delta(l, inc(l))))
    custom = F.col("pricing_mode") == "custom"
    price = F.when(custom, F.lit(None).cast("decimal(12,2)")) \
        .otherwise(to_money(F.coalesce(F.col("base_selling_price"), money_zero()) + F.col("price_adjust")))
    return (valid.withColumn("subtotal_cost", subtotal)
                 .withColumn("price_adjust", adjust)
                 .withColumn("selling_price", price)
                 .withColumn("profit", to_money(F.col("selling_price") - F.col("subtotal_cost")))
                 .withColumn("needs_price_confirmation", F.coalesce(custom, F.lit(False)))
                 .withColumnRenamed("request_id", "order_id"))


def line_choices() -> Column:
    """Of a priced order, its recipe's lines by name with whether each is included: what the customer may be told."""
    ex, xt = F.col("excluded_ids"), F.col("extra_ids")
    return F.transform("lines", lambda l: F.struct(l["name"].alias("ingredient_name"),
                                                   F.coalesce(_included(l, ex, xt), F.lit(False)).alias("is_included")))


class _Flat:
    """Field access on top-level columns, so the line rules serve exploded rows."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def order_lines(priced: DataFrame) -> DataFrame:
    """Op 11: one snapshot row per (order, recipe line), from op 10's rows.

    The recipe lines are exploded (`inline`) and the include / cost / delta
    rules applied to the flat columns. Left-out lines keep their quantity with
    cost 0. The line id is derived from the natural key (order, ingredient), so
    reruns give the same ids.
    """
    rows = priced.select("order_id", "created_at", "excluded_ids", "extra_ids", F.inline("lines"))
    line = _Flat()
    inc = F.coalesce(_included(line, F.col("excluded_ids"), F.col("extra_ids")), F.lit(False))
    return rows.select(
        F.concat_ws(":", F.col("order_id").cast("string"), F.col("ingredient_id").cast("string")).alias("id"),
        "order_id", "ingredient_id",
        F.col("name").alias("ingredient_name_snapshot"), inc.alias("is_included"),
        F.col("quantity").alias("quantity_snapshot"), F.col("unit_price").alias("unit_price_snapshot"),
        _line_cost(line, inc).alias("cost_snapshot"), _line_delta(line, inc).alias("price_delta_applied"),
        "is_allergen", "display_order", "created_at")


def number_orders(valid: DataFrame, start: int = 1, prefix: str = ORDER_NUMBER_PREFIX,
                  order_cols: tuple[str, ...] = ("created_at", "request_id"),
                  num_partitions: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Op 12: `PREFIX-YYYYMMDD-NNNN` from one global sequence in creation order.

    The sequence does not restart daily. Deviation: numbers past 9999 grow to
    five digits instead of being cut to four (cutting collides on the unique
    order number). The whole input is checkpointed, so pass only the columns
    the numbered result needs; `keep`, which writes rows and gives them back as
    written (`kept_rows`), may stand in for the checkpoint.

    No single-partition window: rows are range-partitioned on the order keys and
    sorted within partitions, then checkpointed to the shared checkpoint folder,
    so partition contents are fixed even if an executor is lost and a stage is
    rerun. Each row's number is its partition's offset (from per-partition
    counts, one row per partition, broadcast) plus its index inside the
    partition.
    """
    spark = valid.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = valid.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    place = {"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}
    tagged = laid.checkpoint(eager=True).withColumns(place) if keep is None else keep(laid.withColumns(place))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window below runs over at most `n` rows.
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_offset"))
    seq = (F.col("_offset") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)) + F.lit(start))
    numbered = tagged.join(F.broadcast(offsets), "_pid").withColumn("order_seq", seq)
    digits = F.when(F.col("order_seq") < 10000, F.lpad(F.col("order_seq").cast("string"), 4, "0")) \
        .otherwise(F.col("order_seq").cast("string"))
    number = F.concat(F.lit(prefix + "-"), F.date_format("created_at", "yyyyMMdd"), F.lit("-"), digits)
    return numbered.withColumn("order_number", number).drop("_pid", "_mid", "_offset")


def _preview_price(menu_lines: Column, pricing_mode: Column, base: Column, excluded: Column,
                   extras: Column) -> Column:
    """The price the customer sees while choosing: active and visible lines only.

    Selections start at the menu default (add-ons off, others on); the request's
    extras turn add-ons on and its exclusions turn toggleable lines off.
    """
    def chosen(l: Column) -> Column:
        toggle_off = F.coalesce(l["is_customer_optional"] & l["is_customer_removable"]
                                & F.array_contains(excluded, l["ingredient_id"]), F.lit(False))
        return F.when(l["pricing_rule"] == ADDON, F.coalesce(F.array_contains(extras, l["ingredient_id"]),
                                                             F.lit(False))).otherwise(~toggle_off)

    def delta(l: Column) -> Column:
        c = chosen(l)
        return to_money(F.when((l["pricing_rule"] == REDUCE_ON_REMOVE) & ~c, -l["price_delta"])
                        .when((l["pricing_rule"] == ADDON) & c, l["price_delta"])
                        .otherwise(F.lit(0)))

    adjust = F.aggregate(menu_lines, money_zero(), lambda acc, l: to_money(acc + delta(l)))
    return F.when(pricing_mode == "custom", F.lit(None).cast("decimal(12,2)")) \
        .otherwise(to_money(F.coalesce(base, money_zero()) + adjust))


def price_preview(requests: DataFrame, menu: DataFrame) -> DataFrame:
    """Op 13: preview price per request (needs `recipe_id`), from op 4's menu."""
    m = menu.select("recipe_id", F.col("pricing_mode").alias("_menu_mode"),
                    F.col("base_selling_price").alias("_menu_base"), F.col("ingredients").alias("_menu_lines"))
    j = requests.join(m, "recipe_id", "left")
    return j.withColumn("preview_price", _preview_price(F.col("_menu_lines"), F.col("_menu_mode"),
                                                        F.col("_menu_base"), F.col("excluded_ids"),
                                                        F.col("extra_ids"))) \
            .drop("_menu_mode", "_menu_base", "_menu_lines")


def preview_mismatches(priced: DataFrame, menu: DataFrame) -> DataFrame:
    """Op 13: orders whose server price differs from the customer's preview.

    The preview is computed on the priced rows themselves (one dimension join),
    so no join of two order-sized tables is needed.
    """
    previewed = price_preview(priced, menu)
    return previewed.filter(~F.col("selling_price").eqNullSafe(F.col("preview_price"))) \
        .select("order_id", "recipe_id", "selling_price", "preview_price")
