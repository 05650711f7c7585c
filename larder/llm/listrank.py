"""Ranking of a linked list that is spread over the cluster.

Each round splices out an independent set of about a third of the elements:
those whose seeded hash is less than both neighbours'. The element before takes
over the weight and the link. What is left after the last round is a list of
bounded length, which is walked; then the rounds are undone in reverse, each
element adding its offset to the sum of the one that took it over. Joins are on
unique ids, so no key is hot, and all rounds together move about three times
the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import materialise, release

#: Elements of the contracted list that one task walks.
FINISH = 8192


def _coin(col: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), col)


def prefix_sums(items: DataFrame, weights: list[str], finish: int = FINISH) -> DataFrame:
    """`items(id long, next long, weights long)` -> `(id, weights)`, each the sum over all elements before.

    `next` is null at the end of a list. Ids are unique and every `next` is
    some other's id at most once; then all lists of the table are ranked, each
    from 0, and an empty table gives an empty result.
    """
    now, rounds = materialise(items.select("id", "next", *weights), "list"), []
    while now.count() > finish:
        step = materialise(_splice(now, weights, len(rounds)), "list")
        release(now)
        rounds.append(step)
        now = materialise(step.where("id is not null").select("id", "next", *weights), "list")
    done = materialise(_walk(now, weights), "ranks")
    release(now)
    for step in reversed(rounds):
        gone = step.where("gone is not null").select("gone", "id", *(f"{w}_before" for w in weights))
        back = gone.join(done, "id").select(F.col("gone").alias("id"), *((F.col(w) + F.col(f"{w}_before")).alias(w) for w in weights))
        after = materialise(done.unionByName(back), "ranks")
        release(done)
        release(step)
        done = after
    return done


def _splice(items: DataFrame, weights: list[str], k: int) -> DataFrame:
    """One round: the elements that stay, and beside the one before it each that goes, with the sums it adds."""
    own, of_next = _coin(F.col("id"), k), F.when(F.col("next").isNotNull(), _coin(F.col("next"), k))
    low = items.where(of_next.isNull() | (own < of_next))
    high = items.where(of_next < own)
    rest = items.where(of_next == own)
    x = low.select(F.col("id").alias("x_id"), F.col("next").alias("x_next"), *(F.col(w).alias(f"x_{w}") for w in weights))
    both = high.join(x, F.col("next") == F.col("x_id"), "full")
    met = F.col("id").isNotNull() & F.col("x_id").isNotNull()
    spliced = both.select(
        F.coalesce("id", "x_id").alias("id"),
        F.when(F.col("x_id").isNotNull(), F.col("x_next")).otherwise(F.col("next")).alias("next"),
        *((F.coalesce(w, F.lit(0)) + F.coalesce(f"x_{w}", F.lit(0))).cast("long").alias(w) for w in weights),
        F.when(met, F.col("x_id")).alias("gone"),
        *(F.when(met, F.col(w)).alias(f"{w}_before") for w in weights))
    none = F.lit(None).cast("long")
    return spliced.unionByName(rest.select("id", "next", *weights, none.alias("gone"), *(none.alias(f"{w}_before") for w in weights)))


def _walk(items: DataFrame, weights: list[str]) -> DataFrame:
    """The sums of a list short enough for one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for b in batches:
            rows |= {r["id"]: r for r in b.to_pylist()}
        out = []
        for at in rows.keys() - {r["next"] for r in rows.values()}:
            sums = dict.fromkeys(weights, 0)
            while at is not None:
                out.append({"id": at, **sums})
                sums = {w: s + rows[at][w] for w, s in sums.items()}
                at = rows[at]["next"]
        for k in range(0, len(out), 4096):
            yield pa.RecordBatch.from_pylist(out[k:k + 4096], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("id", *weights)])
    return items.coalesce(1).mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *weights)))
