"""Op 35 through the whole key graph: deletes that cascade, are restricted, and stand or fall per key."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.quality import REFERENCES
from larder.session import checkpoint_dir

CASCADE, RESTRICT = "cascade", "restrict"
# The references along which the data model cascades; it restricts along all others.
CASCADES = {("recipe_lines", "recipe_id"), ("order_lines", "order_id")}

References = Mapping[str, Mapping[str, str]]


def child_first(references: References, cascades: set[tuple[str, str]] = CASCADES) -> list[str]:
    """The tables in the order of their deletes: each before those that its rows, or rows which go with them, refer to.

    Raises ValueError if they wait for each other in a circle.
    """
    tables = sorted({*references, *(p for edges in references.values() for p in edges.values())})
    after = {}
    for t in tables:
        goes = [t]
        for g in goes:
            goes += [c for c, edges in references.items() for fk, p in edges.items() if p == g and (c, fk) in cascades and c not in goes]
        after[t] = {p for g in goes for p in references.get(g, {}).values()} - set(goes)
    out: list[str] = []
    while after:
        free = [t for t in after if not any(t in later for later in after.values())]
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {sorted(after)}")
        out += free
        for t in free:
            del after[t]
    return out


class Deletion:
    """`outcome`: table_name, id, outcome, n_cascaded, n_blocking of every key asked for; `tables`: what is left."""

    def __init__(self, outcome: DataFrame, tables: dict[str, DataFrame]):
        self.outcome, self.tables = outcome, tables


def delete_closure(tables: Mapping[str, DataFrame], deletes: DataFrame, references: References = REFERENCES,
                   cascades: set[tuple[str, str]] = CASCADES) -> Deletion:
    """Delete the keys `deletes(table_name, id)` from `tables`, as the data model's foreign keys have it.

    Tables are taken child first, so a key that only rows deleted with this
    request refer to is free. Within a table each key stands alone: what its
    delete cascades to goes with it, and where a row that stays refers to any of
    these along a restricting edge, the key is `blocked` and nothing of it goes.
    Others are `deleted`; a key that isn't there (or whose row went by a cascade
    before) is `missing`. Ids compare as strings; keys asked for twice count
    once; null keys refer to nothing. Edges whose column a table lacks are left
    out, and tables without `id` can't be asked for.

    Referring rows are counted per key before any join, so a key that a third
    of them share is one row there. Only keys and counts are checkpointed; what
    is left of a table is one anti join per edge.
    """
    checkpoint_dir(deletes.sparkSession)
    live, outcomes = dict(tables), []
    asked = deletes.select("table_name", F.col("id").cast("string").alias("id")).where("id is not null").distinct()
    for t in child_first(references, cascades):
        if t not in live or "id" not in live[t].columns:
            continue
        there = live[t].select(F.col("id").cast("string").alias("id")).distinct().withColumn("there", F.lit(True))
        roots = asked.where(F.col("table_name") == t).select("id").join(there, "id", "left").checkpoint()
        parts = _closure(t, roots.where("there").select(F.col("id").alias("root"), "id"), live, references, cascades)
        told = roots
        for name, counts in (("n_cascaded", _cascaded(parts, live)), ("n_blocking", _blocking(parts, live, references, cascades))):
            told = told.withColumn(name, F.lit(0).cast("long")) if counts is None else \
                told.join(counts.select(F.col("root").alias("id"), F.col("n").alias(name)), "id", "left").fillna(0, [name])
        told = told.checkpoint()  # a row for each key asked for
        what = F.when(F.col("there").isNull(), "missing").when(F.col("n_blocking") > 0, "blocked").otherwise("deleted")
        outcomes.append(told.select(F.lit(t).alias("table_name"), "id", what.alias("outcome"), "n_cascaded", "n_blocking"))
        gone = told.where("there and n_blocking = 0").select(F.col("id").alias("root"))
        # Followed from the deleted keys alone, so that what is left of a table doesn't look for its keys again.
        goes = _closure(t, gone.withColumn("id", F.col("root")), live, references, cascades)
        live = live | {p.table: _left(live[p.table], p.by, p.keys) for p in goes}
    return Deletion(reduce(DataFrame.unionByName, outcomes), live)


@dataclass
class _Part:
    """Rows of `table` that go with a root: those whose column `by` is in `keys(root, key)`."""

    table: str
    by: str
    keys: DataFrame


def _edges_to(table: str, live: Mapping[str, DataFrame], references: References) -> list[tuple[str, str]]:
    return [(child, fk) for child, edges in references.items() for fk, to in edges.items()
            if to == table and child in live and fk in live[child].columns]


def _ids(part: _Part, live: Mapping[str, DataFrame]) -> DataFrame | None:
    """(root, key): the ids of a part's rows; None where its table has none to refer to."""
    if part.by == "id":
        return part.keys
    child = live[part.table]
    if "id" not in child.columns:
        return None
    rows = child.select(F.col(part.by).cast("string").alias("key"), F.col("id").cast("string").alias("_id"))
    return rows.join(part.keys, "key").select("root", F.col("_id").alias("key"))


def _closure(table: str, roots: DataFrame, live: Mapping[str, DataFrame], references: References,
             cascades: set[tuple[str, str]]) -> list[_Part]:
    """The root's own part and those of the tables below along cascading edges; tables referring in a tree."""
    out = [_Part(table, "id", roots.withColumnRenamed("id", "key"))]
    for part in out:
        ids = _ids(part, live)
        if ids is not None:
            out += [_Part(child, fk, ids) for child, fk in _edges_to(part.table, live, references) if (child, fk) in cascades]
    reached = [p.table for p in out]
    if len(set(reached)) < len(reached):
        raise ValueError(f"a delete in {table} reaches a table along two ways: {reached}")
    return out


def _counted(child: DataFrame, fk: str, keys: DataFrame) -> DataFrame:
    """(root, n): rows of `child` that refer to the keys of each root."""
    per_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.join(keys, "key").groupBy("root").agg(F.sum("n").alias("n"))


def _sum(counts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, counts).groupBy("root").agg(F.sum("n").alias("n")) if counts else None


def _cascaded(parts: list[_Part], live: Mapping[str, DataFrame]) -> DataFrame | None:
    return _sum([_counted(live[p.table], p.by, p.keys) for p in parts[1:]])


def _blocking(parts: list[_Part], live: Mapping[str, DataFrame], references: References,
              cascades: set[tuple[str, str]]) -> DataFrame | None:
    """Rows that refer to a root's rows along restricting edges and don't go with it."""
    counts = []
    of = {p.table: p for p in parts}
    for p in parts:
        ids = _ids(p, live)
        for child, fk in _edges_to(p.table, live, references) if ids is not None else []:
            if (child, fk) in cascades:
                continue
            counts.append(_counted(live[child], fk, ids))
            if child in of:  # those that go with the same root don't block it
                mine = of[child]
                both = (live[child].select(F.col(fk).cast("string").alias("key"), F.col(mine.by).cast("string").alias("_by"))
                        .join(ids, "key").withColumnRenamed("root", "_root"))
                same = both.join(mine.keys.withColumnRenamed("key", "_key"), (F.col("_by") == F.col("_key")) & (F.col("_root") == F.col("root")))
                counts.append(same.groupBy("root").agg((-F.count(F.lit(1))).alias("n")))
    return _sum(counts)


def _left(rows: DataFrame, by: str, keys: DataFrame) -> DataFrame:
    """The rows whose column `by` is not among the keys."""
    dead = keys.select(F.col("key").alias("_dead")).distinct()
    return rows.join(dead, F.col(by).cast("string") == F.col("_dead"), "left_anti")


def correct_customers(customers: DataFrame, deleted_orders: DataFrame) -> DataFrame:
    """Customers after orders of theirs are deleted: one order less and its price (NULL = 0) less for each, not below 0.

    Clamped once per customer; for prices below 0, where the order of deletes
    matters, fold the log with op 24. `last_order_at` stays as it is.
    """
    per = deleted_orders.groupBy(F.col("customer_id").alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col("selling_price"), F.lit(0))).alias("_s"))
    j = customers.join(per, F.col("id") == F.col("_c"), "left")
    zero = F.lit(0)
    kind = {f.name: f.dataType for f in customers.schema.fields}
    less = {"total_orders": "_n", "total_spent": "_s"}
    return j.select(*[F.when(F.col("_c").isNotNull(), F.greatest(zero, F.coalesce(F.col(c), zero) - F.col(less[c])))
                      .otherwise(F.col(c)).cast(kind[c]).alias(c) if c in less else F.col(c) for c in customers.columns])
