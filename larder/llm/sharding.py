"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within each source by a seeded hash and ranked; a row's
fractional rank is (rank - 1/2) / rows of the source. Sorted by it, every
stretch of rows holds the sources in the corpus's proportions, so the order is
cut into shards of equal row counts (at most one apart), each a like mixture.

Neither ranking needs a source, or the corpus, in one task: rows fall into
slices of the hash (or of the fractional rank), which are uniform whatever the
source's size. A row's rank is the count of the slices before its own, from a
small table of counts, plus its place in the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import fresh

#: Slices of the hash and of the fractional rank; rows of a slice are sorted in one task.
SLICES = 4096
HASH_DIGITS = 15


def shuffled_hash(seed: int, *cols: Column) -> Column:
    """60 bits of an MD5 of the columns, the same on every run and engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long")


def _numbered(df: DataFrame, group: list[str], slice_: str, order: list[Column], number: str, total: str) -> DataFrame:
    """`df` with each row's number from 1 within `group` in `order`, and the group's rows.

    `slice_` must rise with `order`. Null group values are a group.
    """
    keys = [*group, slice_]
    n, before, at, *of = fresh(["llm_n", "llm_ahead", "llm_place", *[f"llm_of_{k}" for k in range(len(keys))]], [*df.columns, number, total])
    counts = df.groupBy(*keys).agg(F.count("*").alias(n))
    up = Window.partitionBy(*group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*[F.col(c).alias(x) for c, x in zip(keys, of)], F.coalesce(F.sum(n).over(up), F.lit(0)).alias(before),
                          F.sum(n).over(Window.partitionBy(*group)).alias(total))
    same = None
    for c, x in zip(keys, of):
        eq = F.col(c).eqNullSafe(F.col(x))
        same = eq if same is None else same & eq
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(at, place).join(ahead, same).withColumn(number, F.col(before) + F.col(at)).drop(at, before, *of)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 1, slices: int = SLICES) -> DataFrame:
    """`docs` with a struct column `sharding`: size, text_crc32, shard (from 0), slot (gapless from 0).

    Row counts of shards are at most one apart, and each source is spread over
    them in its proportion. Null sources are a source; null doc_ids and texts
    hash as "null"; the size is the text's UTF-8 bytes (null: none) plus 1.
    Ties are broken by doc_id, CRC and size; rows equal in all these and in
    source are interchangeable, and each has a slot of its own. An empty table
    gives an empty result. A column called `sharding` gives way; other columns
    stay. Only ids, sizes and hashes are ranked; a text moves with its row.
    """
    columns = [c for c in docs.columns if c.lower() != "sharding"]
    names = fresh(["k_id", "k_source", "k_size", "k_crc", "k_hash", "k_cut", "k_rank", "k_rows", "k_frac", "k_part",
                   "k_place", "k_all"], columns)
    i, src, size, crc, h, cut, rank, rows, frac, part, place, total = names
    text = F.coalesce(F.col("text"), F.lit(""))
    d = (docs.select(*columns)
         .withColumn(i, F.col("doc_id")).withColumn(src, F.col("source").cast("string"))
         .withColumn(size, (F.octet_length(text) + 1).cast("long")).withColumn(crc, F.crc32(F.encode(text, "UTF-8")))
         .withColumn(h, shuffled_hash(seed, F.col("doc_id"), F.col(crc), F.col(size)))
         .withColumn(cut, (F.col(h) / F.lit(float(16 ** HASH_DIGITS)) * slices).cast("int")))
    within = [F.col(h), F.col(i), F.col(crc), F.col(size)]
    d = _numbered(d, [src], cut, within, rank, rows)
    d = (d.withColumn(frac, (2 * F.col(rank) - 1).cast("double") / (2 * F.col(rows)).cast("double"))
         .withColumn(part, (F.col(frac) * slices).cast("int")))
    across = [F.col(frac), F.col(src), *within]
    d = _numbered_all(d, part, across, place, total)
    n, at = F.col(total), F.col(place) - 1
    small = F.floor(n / shards).cast("long")
    big = n - small * shards                       # shards with one row more
    edge = big * (small + 1)
    shard = F.when(at < edge, F.floor(at / (small + 1))).otherwise(big + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    shard = shard.cast("long")
    slot = F.when(at < edge, at - shard * (small + 1)).otherwise(at - edge - (shard - big) * small)
    return d.select(*columns, F.struct(F.col(size).alias("size"), F.col(crc).alias("text_crc32"),
                                       shard.cast("int").alias("shard"), slot.cast("long").alias("slot")).alias("sharding"))


def _numbered_all(df: DataFrame, slice_: str, order: list[Column], number: str, total: str) -> DataFrame:
    one = fresh(["llm_one"], [*df.columns, number, total])[0]
    return _numbered(df.withColumn(one, F.lit(0)), [one], slice_, order, number, total).drop(one)
