"""Ops 34-35: apply an ordered change table; cascade and restrict deletes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


INSERT, UPDATE, DELETE = "insert", "update", "delete"


def given(col: str) -> str:
    """Name of the flag column telling that a change gives `col` (NULL included)."""
    return f"{col}__set"


def apply_changes(base: DataFrame, changes: DataFrame, key: str | Sequence[str], columns: Sequence[str],
                  defaults: Mapping[str, object] | None = None, seq: str = "seq", op: str = "op",
                  changed_at: str = "changed_at", updated_at: str = "updated_at") -> DataFrame:
    """Op 34: apply inserts, partial updates and deletes, in `seq` order per key.

    `changes` holds the key, `seq`, `op`, `changed_at`, and for each data column
    `c` its value and a flag `c__set` (so an explicit NULL is a value).

    Per key, the last insert or delete is the reset. After a delete the row is
    gone and later updates are ignored; after an insert only changes from it on
    count (columns it does not give take `defaults`); with neither, updates
    apply to an existing base row only. The latest given value per column wins,
    and `updated_at` becomes the time of the key's last change.

    One group-by over the changes (all `max_by` / `max`, partially aggregated,
    so a hot key is combined map-side), then one full outer join with the base
    on the key. No sequential replay.
    """
    keys = [key] if isinstance(key, str) else list(key)
    defaults = dict(defaults or {})
    reset = F.col(op).isin(INSERT, DELETE)
    aggs = [F.max(F.when(reset, F.col(seq))).alias("_reset_seq"),
            F.max_by(F.col(op), F.when(reset, F.col(seq))).alias("_reset_op"),
            F.max_by(F.col(changed_at), F.col(seq)).alias("_last_change")]
    for c in columns:
        set_seq = F.when(F.col(given(c)), F.col(seq))
        aggs += [F.max(set_seq).alias(f"_s_{c}"), F.max_by(F.col(c), set_seq).alias(f"_v_{c}")]
    per_key = changes.groupBy(*keys).agg(*aggs).withColumn("_changed", F.lit(True))
    b = base.withColumn("_in_base", F.lit(True))
    j = b.join(per_key, keys, "full_outer")
    inserted = F.col("_reset_op") == INSERT
    deleted = F.col("_reset_op") == DELETE
    keep = (F.when(deleted, False).when(inserted, True)
            .otherwise(F.coalesce(F.col("_in_base"), F.lit(False))))
    out_cols = []
    for c in base.columns:
        if c in keys:
            out_cols.append(F.col(c))
        elif c in columns:
            taken = F.col(f"_s_{c}").isNotNull() & (F.col("_reset_seq").isNull()
                                                     | (F.col(f"_s_{c}") >= F.col("_reset_seq")))
            dflt = F.lit(defaults.get(c)).cast(base.schema[c].dataType)
            out_cols.append(F.when(taken, F.col(f"_v_{c}")).when(inserted, dflt).otherwise(F.col(c)).alias(c))
        elif c == updated_at:
            out_cols.append(F.when(F.col("_changed"), F.col("_last_change").cast(base.schema[c].dataType))
                            .otherwise(F.col(c)).alias(c))
        else:
            out_cols.append(F.when(inserted, F.lit(defaults.get(c)).cast(base.schema[c].dataType))
                            .otherwise(F.col(c)).alias(c))
    return j.filter(keep).select(*out_cols)


def cascade_delete(child: DataFrame, deleted_keys: DataFrame, fk: str) -> DataFrame:
    """Op 35: child rows left after their parents are deleted (ON DELETE CASCADE)."""
    dead = deleted_keys.select(F.col(deleted_keys.columns[0]).alias(fk)).distinct()
    return child.join(dead, fk, "left_anti")


def restrict_check(child: DataFrame, deleted_keys: DataFrame, fk: str) -> DataFrame:
    """Op 35: deletes that a child row blocks (ON DELETE RESTRICT), with the
    number of blocking child rows. Children are counted per key first."""
    dead = deleted_keys.select(F.col(deleted_keys.columns[0]).alias(fk)).distinct()
    per_key = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("blocking_rows"))
    return per_key.join(dead, fk, "left_semi")


def new_line_defaults(lines: DataFrame, added: DataFrame, seq: str = "seq") -> DataFrame:
    """Op 34, recipe lines: fill a new line's defaults as the recipe editor does.

    Not optional, `included_fixed`, delta 0, not an add-on, and display order =
    the recipe's current line count + 1, counting earlier additions of the same
    batch in `seq` order. Existing lines are counted per recipe first (partial
    aggregation); the rank runs over one recipe's additions, which (recipe,
    ingredient) uniqueness bounds by the catalog.
    """
    counts = lines.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("_have"))
    rank = F.row_number().over(Window.partitionBy("recipe_id").orderBy(seq))
    out = added.join(counts, "recipe_id", "left").withColumn("_rank", rank)
    fill = {
        "is_customer_optional": F.lit(False),
        "pricing_rule": F.lit("included_fixed"),
        "price_delta": F.lit(0).cast("decimal(12,2)"),
        "is_addon": F.lit(False),
        "display_order": (F.coalesce(F.col("_have"), F.lit(0)) + F.col("_rank")).cast("int"),
    }
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in added.columns else v)
    return out.drop("_have", "_rank")
