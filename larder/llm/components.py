"""Connected components of a link table by alternating large-star and small-star steps.

Every step is partial aggregations and equi-joins, so a hub's links are spread
by AQE's skew join, and nothing but two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """`links(a, b)` -> `(node, root)` for every linked node but the roots.

    `root` is the smallest node that can be reached. Rows with a null end or
    with a = b link nothing; repeated rows and an empty table are fine.
    """
    pair = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(pair.distinct(), "links")
    state = _state(now)
    while state[0]:
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        large = now.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hang = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(hang.union(low).distinct(), "links")
        release(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(links: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.sum(digest)).first())
