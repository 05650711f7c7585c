"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source, each source's target over its tokens is a
repetition rate, and a document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with the rate's fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import SPACE_CLASS, fresh, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def n_tokens(text: Column) -> Column:
    """Words parted by 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS)), F.lit(0)).cast("long")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) of 52 bits of an MD5, the same on every run and engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`per_source(source, source_size)` -> with `target`.

    Sources by code point, null last, weigh `weights` in turn. Shares of all
    tokens by weight stop at `max_repeats` times the source; what is over is
    shared by weight among the rest. With the sources in the order of cap /
    weight, the capped are a prefix: a source is capped if, once all before it
    are, its share still reaches its cap. All sums are exact integers. One row
    per source: the only window here without partitions.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (per_source.withColumn("weight", weight.cast("long"))
              .withColumn("all", F.sum("source_size").over(every))
              .withColumn("left", F.col("all") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
              .withColumn("weights_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("capped", F.col("left") * F.col("weight") >= cap * F.col("weights_left")))
    free = F.when(~F.col("capped"), F.struct("left", "weights_left"))
    first_free = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (ranked.withColumn("free", first_free)
            .select("source", "source_size",
                    F.when(F.col("capped"), cap.cast("double"))
                    .otherwise((F.col("free.left") * F.col("weight")).cast("double") / F.col("free.weights_left").cast("double"))
                    .alias("target")))


def plan_mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`docs` with a struct column `mix`: size, source_size, target, copies, taken.

    A null or empty text has size 0; a source without words has target 0 and
    its documents no copies. Null sources are one source, the last. Rows that
    repeat a doc_id share its draw, rows without one draw by their text. An
    empty table gives an empty result. A column called `mix` gives way; other
    columns stay as they are. The sources' totals are the only thing that a
    single task sees; a hot source is summed before the shuffle. Targets are
    joined by broadcast where the written table is under Spark's threshold;
    beyond it AQE splits the hot sources of a sort-merge join.
    """
    columns = [c for c in docs.columns if c.lower() != "mix"]
    size, key, t, of = fresh(["llm_size", "llm_source", "llm_target", "llm_of"], columns)
    sized = docs.select(*columns).withColumn(size, n_tokens(F.col("text"))).withColumn(key, F.col("source").cast("string"))
    totals = sized.groupBy(F.col(key).alias("source")).agg(F.sum(size).alias("source_size"))
    # Written first: Spark then knows the table's bytes, and broadcasts it or not by its own threshold.
    targets = materialise(source_targets(totals, weights, max_repeats), "targets").select(
        F.struct("source_size", "target").alias(t), F.col("source").alias(of))
    joined = sized.join(targets, F.col(key).eqNullSafe(F.col(of)))
    rate = F.when(F.col(f"{t}.source_size") > 0, F.col(f"{t}.target") / F.col(f"{t}.source_size")).otherwise(F.lit(0.0))
    draw = unit_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.md5("text")))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    mix = F.struct(F.col(size).alias("size"), F.col(f"{t}.source_size").alias("source_size"),
                   F.col(f"{t}.target").alias("target"), copies.alias("copies"), (F.col(size) * copies).alias("taken"))
    return joined.select(*columns, mix.alias("mix"))


def mix_sources(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each document as many times as it is taken, columns unchanged, whatever they are called.

    Nulls, ties, repeated rows and an empty table as in `plan_mix`.
    """
    plan = plan_mix(docs.select(F.struct("*").alias("_llm_row"), F.col("doc_id").alias("doc_id"),
                                F.col("text").alias("text"), F.col("source").alias("source")), seed, weights, max_repeats)
    times = F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))
    return plan.select("_llm_row", times.alias("_llm_copy")).select("_llm_row.*")
