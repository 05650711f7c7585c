"""Op 29: integrity audit, one row per rule with its violation count.

The rules are the data model's constraints: unique keys, foreign keys,
NOT NULL, allowed enum values, and "NULL price only under custom pricing".
Each check is one aggregate (unique: a partial-aggregated group-by; foreign
key: an anti join); per-row rules on one table share one scan (`row_checks`);
the audit is their `unionByName`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.schemas import COST_METHODS, ORDER_STATUSES, PRICING_MODES, PRICING_RULES

# The data model's rules.
NULLABLE = {
    "product_types": {"description"},
    "sizes": {"people_range"},
    "ingredients": {"notes"},
    "recipes": {"base_selling_price"},
    "customers": {"address", "last_order_at"},
    "orders": {"selling_price", "profit", "customer_notes", "admin_notes", "pickup_date", "pickup_time"},
}
UNIQUE = {
    "product_types": [["id"], ["key"]],
    "sizes": [["id"], ["key"]],
    "ingredients": [["id"]],
    "recipes": [["id"], ["product_type_id", "size_id"]],
    "recipe_lines": [["id"], ["recipe_id", "ingredient_id"]],
    "customers": [["id"], ["phone"]],
    "orders": [["id"], ["order_number"]],
    "order_lines": [["id"]],
}
REFERENCES = {
    "recipes": {"product_type_id": "product_types", "size_id": "sizes"},
    "recipe_lines": {"recipe_id": "recipes", "ingredient_id": "ingredients"},
    "orders": {"customer_id": "customers", "product_type_id": "product_types", "size_id": "sizes", "recipe_id": "recipes"},
    "order_lines": {"order_id": "orders", "ingredient_id": "ingredients"},
}
ALLOWED = {
    "sizes": {"pricing_mode": PRICING_MODES},
    "ingredients": {"cost_method": COST_METHODS},
    "recipe_lines": {"pricing_rule": PRICING_RULES},
    "orders": {"status": ORDER_STATUSES},
}


def _row(df: DataFrame, rule: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations")) \
        .select(F.lit(rule).alias("rule"), "violations")


def unique_check(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Rows beyond the first for each repeated key value (NULL keys ignored)."""
    nn = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counts = df.filter(nn).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _row(counts, rule, F.sum(F.col("_n") - 1))


def foreign_key_check(child: DataFrame, fk: str, parent: DataFrame, pk: str, rule: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent row."""
    # Counted per key before the join: a key that a third of the rows hold is one row.
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    orphans = keys.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return _row(orphans, rule, F.sum("_n"))


def allowed_values_check(df: DataFrame, col: str, values: Sequence[str], rule: str) -> DataFrame:
    """Non-NULL values outside the allowed set."""
    return _row(df, rule, F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(list(values))))


def null_only_when_check(df: DataFrame, col: str, allowed_when: Column, rule: str) -> DataFrame:
    """`col` is NULL where the condition does not allow it."""
    return _row(df, rule, F.count_if(F.col(col).isNull() & ~F.coalesce(allowed_when, F.lit(False))))


def row_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Several per-row rules on one table in one scan: each rule is a condition
    that marks a violating row; one aggregate counts them all, then the counts
    are unpivoted to one (rule, violations) row each."""
    names = list(rules)
    counts = df.agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"_r{i}") for i, n in enumerate(names)])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").cast("long").alias("violations"))
             for i, n in enumerate(names)]
    return counts.select(F.inline(F.array(*pairs)))


def not_null_rule(col: str) -> Column:
    return F.col(col).isNull()


def allowed_values_rule(col: str, values: Sequence[str]) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(list(values))


def null_only_when_rule(col: str, allowed_when: Column) -> Column:
    return F.col(col).isNull() & ~F.coalesce(allowed_when, F.lit(False))


def integrity_audit(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def kitchen_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Op 29 over the kitchen's tables with the data model's own rules.

    `tables` maps names of `schemas.DOMAIN` to frames; rules on a table or a
    column that is not given are left out. All row rules of a table (not null,
    allowed values) share one scan.
    """
    checks = []
    for name, df in tables.items():
        rules = {f"{name}.{c} not null": not_null_rule(c) for c in df.columns if c not in NULLABLE.get(name, ())}
        rules |= {f"{name}.{c} allowed": allowed_values_rule(c, values)
                  for c, values in ALLOWED.get(name, {}).items() if c in df.columns}
        checks.append(row_checks(df, rules))
        checks += [unique_check(df, keys, f"{name}.{', '.join(keys)} unique")
                   for keys in UNIQUE.get(name, []) if set(keys) <= set(df.columns)]
        for fk, parent in REFERENCES.get(name, {}).items():
            if fk in df.columns and parent in tables:
                # Ids are opaque; as text they compare whatever type a table gives them.
                child = df.select(F.col(fk).cast("string").alias(fk))
                ids = tables[parent].select(F.col("id").cast("string").alias("id"))
                checks.append(foreign_key_check(child, fk, ids, "id", f"{name}.{fk} references {parent}"))
    if "recipes" in tables and "sizes" in tables:
        modes = tables["sizes"].select(F.col("id").alias("size_id"), "pricing_mode")
        checks.append(null_only_when_check(tables["recipes"].join(modes, "size_id", "left"), "base_selling_price",
                                           F.col("pricing_mode") == "custom",
                                           "recipes.base_selling_price null only for custom sizes"))
    return integrity_audit(checks)
